"""Main text in sibling blocks of uneven size, on pages without an article."""

from articlespark.llm.htmltext import content_blocks

MENU = "<div><a href=a>Start</a> <a href=b>Sports</a> <a href=c>World</a></div>"


def test_uneven_sections_are_all_kept():
    parts = ["long text " * 300, "short one " * 30, "third one " * 30]
    want = [" ".join(p.split()) for p in parts]
    for tag in ("section", "div"):
        page = f"<div id=content>{''.join(f'<{tag}>{p}</{tag}>' for p in parts)}</div>"
        assert content_blocks(f"<html><body>{MENU}{page}<div>Some site 2024</div></body></html>") == want
        nested = f"<div id=content><div>{''.join(f'<{tag}><p>{p}</p></{tag}>' for p in parts[:2])}</div><div>{parts[2]}</div></div>"
        assert content_blocks(f"<html><body>{MENU}{nested}</body></html>") == want


def test_a_giant_block_does_not_take_short_ones_out():
    parts = ["giant " * 5000] + [f"paragraph {k} of eighty characters, which is quite short beside the giant one" for k in range(6)]
    page = f"<html><body>{MENU}<div>{''.join(f'<div>{p}</div>' for p in parts)}</div></body></html>"
    assert content_blocks(page) == [" ".join(p.split()) for p in parts]


def test_all_articles_with_text_are_kept():
    parts = ["long text " * 300, "second text " * 25]
    page = f"<html><body>{MENU}{''.join(f'<article>{p}</article>' for p in parts)}<div>other</div></body></html>"
    assert content_blocks(page) == [" ".join(p.split()) for p in parts]


def test_link_lists_between_blocks_stay_out():
    parts = ["long text " * 300, "short one " * 30]
    page = f"<div>{parts[0]}</div>{MENU}<div>{parts[1]}</div>"
    got = content_blocks(f"<html><body><div>{page}</div></body></html>")
    assert got == [" ".join(p.split()) for p in parts]
