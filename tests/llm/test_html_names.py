"""Furniture by name: wrappers of it go, topics of an article stay."""

from articlespark.llm.htmltext import content_blocks

TEXT = ["long text of the article " * 12, "second text of the article " * 12]
WANT = [" ".join(t.split()) for t in TEXT]


def page(inside, kind="div"):
    return f"<html><body><{kind}><p>{TEXT[0]}</p>{inside}<p>{TEXT[1]}</p></{kind}></body></html>"


def test_wrapped_furniture_is_left_out():
    note = "Something that a reader says about it, in quite a long line of words. " * 2
    for kind in ("div", "article"):
        for name in ("comments-container", "cookie-wrapper", "ad-container", "page-footer", "sidebar wrapper", "container notice"):
            assert content_blocks(page(f"<div class='{name}'><p>{note}</p></div>", kind)) == WANT, (kind, name)


def test_layouts_are_kept():
    for name in ("page with-sidebar", "has-header", "no-sidebar", "container without-ads", "content-sidebar-wrapper", "page-wrapper sidebar"):
        assert content_blocks(f"<html><body><div class='{name}'>{page('')}</div></body></html>") == WANT, name
    assert content_blocks(page(f"<div class='sidebar with text'>{TEXT[0]}</div>")) == WANT


def test_topics_inside_an_article_are_kept():
    body = "<p>A section of the article that says enough about its topic to be a paragraph.</p>"
    text = body[3:-4]
    for kind in ("article", "main"):
        for name in ("related-work", "advertising", "navigation", "search", "share", "social"):
            got = content_blocks(page(f"<section id='{name}'><h2 id='{name}'>Topic</h2>{body}</section>", kind))
            assert got == [WANT[0], "Topic", text, WANT[1]], (kind, name)
        assert content_blocks(page("<h2 id='comments'>Topic</h2>", kind)) == [WANT[0], "Topic", WANT[1]]
        assert content_blocks(page("<h2><span id='Comments'>Topic</span></h2>", kind)) == [WANT[0], "Topic", WANT[1]]
        assert content_blocks(page("<div class='post-header'><h1>Title</h1></div>", kind)) == [WANT[0], "Title", WANT[1]]


def test_furniture_inside_an_article_goes():
    links = "<ul>" + "".join(f"<li><a href={k}>Another article {k}</a></li>" for k in range(4)) + "</ul>"
    for inside in (f"<div class=related><h3>Related</h3>{links}</div>", "<div class=share>Share: <a href=x>Mail</a></div>",
                   "<div class=ad>Buy this now, it is very good and costs next to nothing at all</div>",
                   "<div role=search>Find</div>", f"<div id='related'><div id='share'>{links}</div></div>"):
        assert content_blocks(page(inside, "article")) == WANT, inside
    assert content_blocks("<article>" + "<div class=share>" * 20_000 + "deep") == ["deep"]  # all the text there is
