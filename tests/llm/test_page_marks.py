"""Marks of boilerplate in pages: what they take, and what they leave."""

import random

from ammlytics.llm import html_extract

PROSE = "<p>The council met on Tuesday to discuss the new bridge.</p>"
SAID = "The council met on Tuesday to discuss the new bridge."


def body(inner):
    return html_extract.extract(f"<html><body>{inner}</body></html>")


def test_names_that_only_contain_a_mark_take_nothing():
    for opened in ('<div class="overflow-hidden">', '<div class="hidden-xs">', '<div class="md:hidden x">', '<div class="legal-news">', '<div id="market-share-report">', '<div class="social-policy">'):
        assert body(f"{opened}{PROSE}</div>") == SAID, opened
        assert body(f"<article><h1>Head</h1>{opened}{PROSE}</div></article>") == f"Head\n{SAID}", opened


def test_a_container_of_the_whole_page_is_no_boilerplate():
    assert body(f'<form id="aspnetForm"><input type=hidden>{PROSE}</form>') == SAID
    assert body(f'<div class="layout sidebar-right">{PROSE}<div class="sidebar">aside</div></div>') == SAID
    inner = f'<article><h1>T</h1>{PROSE}<div class="ad">buy</div></article><div class="comments">{PROSE * 9}</div>'
    assert body(f'<form action="/"><div class="layout sidebar-left">{inner}</div></form>') == f"T\n{SAID}"
    assert body(f'<div class="promo"><main><h1>T</h1>{PROSE}</main></div>') == f"T\n{SAID}"


def test_boilerplate_alone_stays_boilerplate():
    for opened in ('<div class="sidebar">', '<div class="cookie-banner">', '<div class="site-notice">', '<div id="comments">', '<section class="comment-list"><article>', "<nav>", "<div hidden>", '<div role="dialog">'):
        assert body(f"{opened}{PROSE}") == "", opened
    assert body(f"<form>{'<p>Name <input></p>' * 4}</form>") == ""
    assert body(f'<article>{PROSE}</article><div class="related posts">{PROSE * 8}</div><div class="widget x">{PROSE * 8}</div>') == SAID
    assert body(f'{PROSE}<p>one <span class="ad">buy</span> two</p>') == f"{SAID}\none\ntwo"


def test_articles_side_by_side_stay():
    assert body(f"<article>{PROSE * 3}</article><article><p>Second</p></article>") == "\n".join([SAID] * 3 + ["Second"])
    assert body(f"<main>{PROSE}<article><p>Inner</p></article></main><article><p>Other</p></article>") == f"{SAID}\nInner"


def test_alignment_alone_finds_the_text_where_names_say_nothing(spark):
    """Each host has names at random: what all its pages share goes, what varies stays."""
    say = random.Random(4)
    rows, want = [], {}
    for h in range(4):
        top, mid, low = ("".join(say.choices("abcdefghij", k=8)) for _ in range(3))
        for i in range(8):
            n, text = h * 8 + i, [" ".join("".join(say.choices("klmnop", k=5)) for _ in range(12)) for _ in range(1 + i % 3)]
            prose = "".join(f"<p>{t}</p>" for t in text)
            rows.append((n, f"https://h{h}.example/{i}", f'<body><div class="{top}"><p>Shop {h} home about</p></div><div class="{mid}">{prose}</div><div class="{low}"><p>All of it by {h}</p><p>Write to us at {h}</p></div></body>'))
            want[n] = "\n".join(text)
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
    assert all(html_extract.extract(r[2]) != want[r[0]] for r in rows)
