import html as stdlib
import random
import re
import time

import pytest

from veridoc.llm import html_text, registry

SF = "/root/testdata/sf0.001"


def template_text(page):
    """The article of the generated pages, by their template: its paragraphs in order."""
    body = re.search(r"(?s)<article>(.*?)(?:</article>|$)", page)[1]
    parts = re.split(r"</?(?:p|h1|h2)>", body)
    texts = [" ".join(stdlib.unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in parts]
    return "\n\n".join(t for t in texts if t)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_gives_articles(spark, sf):
    d = f"/root/testdata/{sf}"
    pages = {r.page_id: r for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = registry.op2_html_extraction(spark, d).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        assert r.text == template_text(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


LONG = "A sentence of the article that is long enough to count as text, with some words more. "
NOISE = [
    "<nav><ul><li><a href=/>Home</a></li><li>About us</li></ul></nav>",
    "<div class='side-bar sidebar'><p>Side " + LONG + "</p></div>",
    "<aside>" + LONG + "</aside>",
    "<footer>Copyright " + LONG + "</footer>",
    "<div id=cookieConsent role=dialog>We use cookies. " + LONG + "</div>",
    "<form><label>Name</label><input><button>Send</button></form>",
    "<section id='comments'><article class='comment'><p>First! " + LONG + "</p></article></section>",
    "<div class='ad-box'>Buy " + LONG + "</div>",
    "<script>var x='<p>no</p>';</script><style>p{}</style><noscript>no</noscript>",
    "<div style='display: none'>" + LONG + "</div>",
    "<div><a href=a>One</a> <a href=b>Two</a> <a href=c>Three</a></div>",
]


@pytest.mark.parametrize("holder", ["article", "main", "div class=content", "section"])
def test_noise_goes_and_short_blocks_stay(holder):
    rng = random.Random(holder)
    for _ in range(30):
        noise = rng.sample(NOISE, 6)
        inner = ["<h1>The title</h1>"] + [f"<p>{LONG * rng.randint(1, 4)}</p>" for _ in range(4)] + ["<p>Short.", f"<ul><li>{LONG}<li>End &amp; &lt;done&gt; &#233;&nbsp;x</ul>"]
        page = f"<html><head><title>T</title></head><body><header><h2>Site</h2></header>{''.join(noise[:3])}<{holder}>{''.join(inner)}</{holder.split()[0]}>{''.join(noise[3:])}</body></html>"
        got = html_text.main_text(page).split("\n\n")
        assert got[0] == "The title" and got[-3:] == ["Short.", LONG.strip(), "End & <done> é x"] and len(got) == 8, got


def test_own_headers_and_page_forms():
    body = f"<div class=post><div class='post-header'><h1>Title</h1></div><p>{LONG * 3}</p><p>{LONG}</p></div>"
    want = ["Title", (LONG * 3).strip(), LONG.strip()]
    assert html_text.blocks(f"<body><div class=header>Site name</div>{body}</body>") == want
    assert html_text.blocks(f"<body><form id=f>{body}</form></body>") == want
    assert html_text.blocks(f"<body>{body}<form><p>{LONG}</p></form></body>") == want


@pytest.mark.parametrize("n", [1, 12])
def test_bodies_over_several_holders_stay_whole(n):
    long, short = f"<p>{LONG * n * 3}</p><p>{LONG * n * 2}</p>", "<h2>Part</h2><p>Few words.</p><p>A bit more of them.</p>"
    frame = "<body><div class=top><a href=/>Home</a></div><div id=content>%s</div><div class=legal-note><a href=/x>Imprint and terms</a></div></body>"
    bodies = [
        f"<div class=section>{long}</div><div class=section>{short}</div>",
        f"<div class=section>{short}</div><div class=section>{long}</div><div class=section>{short}</div>",
        f"<div class=section>{long}</div><div class=section>{long}{short}</div>",
        f"<section>{short}</section><section><div class=in>{long}</div></section>",
        f"{short}<blockquote>{long}</blockquote>{short}",
        f"{short}<ul><li>One</li><li>{LONG * n * 5}</li><li>Three</li></ul>{short}",
        f"{short}<table><tr><td>{LONG * n * 5}</td></tr><tr><td>b</td></tr></table>{short}",
    ]
    for body in bodies:
        want = [" ".join(x.split()) for x in re.split(r"<[^>]+>", body)]
        assert html_text.blocks(frame % body) == [x for x in want if x], body
    for body in bodies:
        want = [" ".join(x.split()) for x in re.split(r"<[^>]+>", body)]
        assert html_text.blocks(f"<body>{body}</body>") == [x for x in want if x], body


def test_all_of_an_article_stays():
    two = f"<body><nav><a href=/>Home</a></nav><article><h1>A</h1><p>{LONG * 4}</p></article><article><h2>B</h2><p>{LONG}</p></article></body>"
    assert html_text.blocks(two) == ["A", (LONG * 4).strip(), "B", LONG.strip()]
    body = f"<article><p>{LONG * 2}</p><p><a href=/x>{LONG}</a></p><section id='social-history'><p>History.</p></section><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math>.</p><p>{LONG}</p></article>"
    assert html_text.blocks(f"<body>{body}</body>") == [(LONG * 2).strip(), LONG.strip(), "History.", "Let x=1.", LONG.strip()]
    menu = "<ul><li><a href=a>One</a></li><li><a href=b>Two</a></li><li><a href=c>Three</a></li></ul>"
    assert html_text.blocks(f"<body><article><p>{LONG * 2}</p>{menu}</article></body>") == [(LONG * 2).strip()]


@pytest.mark.parametrize("frame, noise", [("<div>{}</div>", "<div>{}</div>"), ("<div class=c1>{}</div>", "<div class=c2>{}</div>"), ("{}", "<div>{}</div>"), ("<table><tr><td>{}</td></tr></table>", "<table><tr><td>{}</td></tr></table>")])
def test_ratios_decide_where_names_say_nothing(monkeypatch, frame, noise):
    text = [f"{LONG * n}".strip() for n in (3, 5, 2, 4)]
    body = "<h1>The title of it all</h1>" + "".join(f"<p>{t}</p>" for t in text) + "<p>Short end.</p>"
    short = [noise.format(f"<b>{x}</b> <i>{y}</i> <u>{x}</u>") for x, y in (("Home", "About"), ("Login", "Help"), ("Terms", "Imprint"))]
    page = f"<body>{short[0]}{short[1]}{frame.format(body)}{short[2]}</body>"
    want = ["The title of it all", *text, "Short end."]
    assert html_text.blocks(page) == want
    monkeypatch.setattr(html_text, "smooth", lambda values: [1.0] * len(values))
    assert html_text.blocks(page) != want


def test_clusters_outside_an_article_count():
    teaser = "<article><h3>More</h3><p>A short teaser.</p></article>"
    body = "<div class=story><h1>Title</h1>" + "".join(f"<p>{LONG * n}</p>" for n in (3, 4, 5)) + "</div>"
    assert html_text.blocks(f"<body><div class=x>{teaser}</div>{body}</body>") == ["Title", *((LONG * n).strip() for n in (3, 4, 5))]


def test_names_that_hide_everything_are_passed_over():
    page = f"<body><div class='widget'><p>{LONG * 2}</p><p>{LONG}</p></div></body>"
    assert html_text.blocks(page) == [(LONG * 2).strip(), LONG.strip()]


@pytest.mark.parametrize("page", ["<p " * 100_000, "<div>x" * 50_000, "<b>" * 50_000 + "</i>" * 50_000, "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000, "<ul><li>" * 30_000 + "x", "<a href='" * 50_000, "<!--" * 50_000, "<table><tr><td>" * 20_000 + "y" + "</td>" * 20_000, "&lt;" * 100_000, "<" * 100_000])
def test_deep_and_broken_pages_cost_linear_time(page):
    begun = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - begun < 10


def test_chunks_give_the_same_events(monkeypatch):
    page = "<body><article><p>a &amp; b &eacute; <b>c</b></p><script>x</script><p>" + LONG * 3 + "</article>"
    want = html_text.main_text(page)
    for n in (1, 2, 3, 7):
        monkeypatch.setattr(html_text, "CHUNK", n)
        assert html_text.main_text(page) == want


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!--", "<html><body></body></html>", "<script>only", "\0", "</p></p>", "<![CDATA[x", "<a href='"])
def test_degenerate_pages(page):
    assert isinstance(html_text.main_text(page), str)
    if not page or page.startswith(("   ", "<html", "<script")):
        assert html_text.main_text(page) == ""


def test_edges(spark):
    rows = [(None, None, None, "k"), (1, "u", "", "k"), (1, "u", "", "k"), (2, "u", "<article>" + "<p>" + "w " * 30000 + "</p>" * 2, None), (3, "u", "plain &lt; text", "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract_main_text(df)
    assert got.columns == ["page_id", "url", "html", "text", "n_chars"]
    assert sorted((r.n_chars, r.text[:14]) for r in got.collect()) == [(0, ""), (0, ""), (0, ""), (12, "plain < text"), (59999, "w w w w w w w ")]
    assert html_text.extract_main_text(df.limit(0)).count() == 0
