"""Pages with known main text, page furniture of several kinds, cut pages, odd input."""
import pytest

from dossier.llm import html

LONG = "This paragraph has a good many words, so that its ratio of text to tags is high. " * 4
PAGES = [
    (None, ""), ("", ""), ("plain text only", "plain text only"), ("<p>one</p>", "one"),
    (f"<nav><a href=x>Menu</a></nav><article><h1>Head &amp; more</h1><p>{LONG}<p>Short.</p><p>a &lt; b&nbsp;c<br>d</p></article><footer>f</footer>",
     f"Head & more\n{LONG.strip()}\nShort.\na < b c d"),
    (f"<header><h1>Site</h1></header><aside>side</aside><main><article><header><h1>T</h1></header><p>{LONG}</p><form><input><button>go</button></form>"
     f"<div class='comments'><p>{LONG}</p></div></article></main>", f"T\n{LONG.strip()}"),
    (f"<body><div id=menu>{'<a href=#>x</a>' * 9}</div><div class=content><p>{LONG}</p><p>{LONG}</p><ul><li>i<li>j</ul></div>"
     f"<div class='cookie-notice'>{LONG}</div><div class=footer>c</div></body>", f"{LONG.strip()}\n{LONG.strip()}\ni\nj"),
    (f"<article><p>{LONG}</p><script>if (a < b) {{ x('</p>') }}</script><style>p{{}}</style><!-- gone --><p>z</p></article>", f"{LONG.strip()}\nz"),
    (f"<article><p><b>{LONG}<br><p>next</p></article><footer>x</footer>", f"{LONG.strip()}\nnext"),
    (f"<article><p>{LONG}</p><p>cut he</p><foot", f"{LONG.strip()}\ncut he"),
    (f"<article><p>{LONG}</p></article><div class=ad>{LONG}</div><article><h2>Two</h2><p>{LONG}</p><p>z</p></article>",
     f"{LONG.strip()}\nTwo\n{LONG.strip()}\nz"),
    (f"<article><div class='entry-header'><h1>T</h1><p>lead</p></div><p>{LONG}</p></article>", f"T\nlead\n{LONG.strip()}"),
    (f"<div id=page><div class='post-header'><h1>T</h1></div><div class=lead><p>{LONG}</p></div><div class=text>{f'<p>{LONG}</p>' * 8}<p>z</p></div></div>",
     "\n".join(["T"] + [LONG.strip()] * 9 + ["z"])),
    (f"<div><p>{LONG}</p><p>{LONG}</p>{'<li><a href=x>more of it</a></li>' * 5}</div>", f"{LONG.strip()}\n{LONG.strip()}"),
    (f"<article><p>{LONG}</p><p>{LONG}</p></article><article><p><a href=x>Next</a> one</p></article>", f"{LONG.strip()}\n{LONG.strip()}"),
    (f"<article><p>{LONG}</p><table><tr><td>a<td>b<tr><td>c</table></article>", f"{LONG.strip()}\na b\nc"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_pages(page, text):
    assert html.main_text(page) == text


def test_the_ratios_decide(monkeypatch):
    body = "".join(f"<div><p>{t}</p></div>" for t in ("x", "y", LONG, LONG, LONG, "z", "w"))
    assert html.main_text(body) == "\n".join([LONG.strip()] * 3)
    found = html.ratios
    monkeypatch.setattr(html, "ratios", lambda lines: found(lines)[[2, 3, 4, 0, 1, 5, 6]])
    assert html.main_text(body) == "\n".join(["x", "y", LONG.strip()])


def test_equal_regions_are_both_kept():
    part = f"<section><h2>H</h2><p>{LONG}</p></section>"
    assert html.main_text(part * 2) == "\n".join(["H", LONG.strip()] * 2)


def test_deep_and_long():
    assert html.main_text("<div>" * 50_000 + LONG) == LONG.strip()
    assert len(html.main_text(f"<p>{LONG * 20_000}</p>")) > 5_000_000


def test_frame(spark):
    df = spark.createDataFrame([(1, "u", "<p>a b</p>", 5), (None, None, None, 6), (1, "u", "<p>a b</p>", 5)],
                               "page_id long, url string, html string, text int")
    got = html.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r["text"], r["n_chars"]) for r in got.collect()) == [("", 0), ("a b", 3), ("a b", 3)]
    assert html.extract(df.limit(0)).count() == 0
