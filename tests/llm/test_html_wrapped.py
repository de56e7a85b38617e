"""Pages whose article stands in a form or in a block with a name of furniture."""

import pytest

from articlespark.llm.htmltext import content_blocks, extract_main_text, parse_lines

TEXT = ["long text of the article " * 12, "second text of the article " * 12]
WANT = [" ".join(t.split()) for t in TEXT]
BODY = f"<p>{TEXT[0]}</p><p>{TEXT[1]}</p>"
NOTE = "Something that a reader says about it, in quite a long line of words. " * 3


@pytest.mark.parametrize("start,end", [
    ("<form>", "</form>"), ('<div class="notice-board">', "</div>"), ('<div class="modal-open">', "</div>"),
    ('<div class="news-banner-story">', "</div>"), ('<div class="widget content">', "</div>"),
    ('<form><div class="popup widget"><div id="social">', "</div></div></form>")])
def test_wrapped_articles_are_kept(start, end):
    menu = "<div class='nav'><a href=a>Start</a> <a href=b>Sports</a></div>"
    comments = f"<div id=comments><article><p>{NOTE}</p></article><article>{NOTE}</article></div>"
    for inside in (f"<article>{BODY}</article>", f"<main>{BODY}</main>", f"<article>{BODY}</article>{comments}"):
        assert content_blocks(f"<html><body>{menu}{start}{inside}{end}<div>Some site</div></body></html>") == WANT
    assert content_blocks(f"<html><body>{start}{BODY}{end}</body></html>") == WANT  # nothing else is left
    assert content_blocks(f"<html><body>{menu}{start}{BODY}{end}<p>Some site 2024</p></body></html>")[:2] == WANT


def test_a_page_whose_only_section_has_such_a_name():
    assert content_blocks(f'<main><section id="comment-policy">{BODY}</section></main>') == WANT
    got = content_blocks(f'<article><p>{TEXT[0]}</p><section id="cookie-recipe"><p>{TEXT[1]}</p></section></article>')
    assert got == WANT


@pytest.mark.parametrize("name", ["reader-discussion", "user-feedback", "comments"])
@pytest.mark.parametrize("kind", ["article", "main", "div"])
def test_what_readers_say_stays_out(name, kind):
    note = f"<div class='{name}'><p>{NOTE}</p><article><p>{NOTE * 6}</p></article></div>"
    assert content_blocks(f"<html><body><article><h1>Title</h1>{BODY}</article>{note}</body></html>") == ["Title", *WANT]
    if kind != "div":
        assert content_blocks(f"<html><body><{kind}>{BODY}<div class='{name}'><p>{NOTE}</p></div></{kind}></body></html>") == WANT


def test_forms_beside_an_article_go():
    form = f"<form><label>{NOTE}</label><input name=q></form>"
    for page in (f"<article>{BODY}</article>{form}", f"{form}<article>{BODY}{form}</article>", f"<div>{BODY}</div>{form}"):
        assert content_blocks(f"<html><body>{page}</body></html>") == WANT


def test_parsing_goes_on_behind_a_broken_piece(monkeypatch):
    from articlespark.llm import htmltext

    plain = htmltext.LineParser.handle_starttag

    def fails(self, tag, attrs):
        if tag == "broken":
            raise AssertionError("piece")
        plain(self, tag, attrs)

    monkeypatch.setattr(htmltext.LineParser, "handle_starttag", fails)
    page = f"<article>\n<p>{TEXT[0]}</p>\n\n<broken a=1><p>{TEXT[1]}</p><broken></article>"
    assert [x.text for x in parse_lines(page).lines] == WANT


def test_extra_and_clashing_columns(spark):
    rows = [(1, "u", f"<article>{BODY}</article>", "x", "y"), (None, None, None, "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, lines string")
    out = extract_main_text(pages)
    assert out.columns == ["page_id", "url", "text"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == [(1, "u", "\n\n".join(WANT)), (None, None, "")]
