import html
import itertools
import random
import re

import pytest

from quillspark.llm.html_extract import best_run, default_scores, extract, extract_text, op1_html_extract, sequence
from quillspark.llm.html_pages import labelled_pages

BODY = "Alpha beta gamma delta epsilon zeta eta theta iota kappa."


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("   \n", ""),
        ("plain &amp; simple\n text", "plain & simple text"),
        ("<p>one</p><p>two</p>", "one two"),
        (f"<nav><a>x</a></nav><article><h1>T</h1><p>{BODY}</p><p>x.</p></article><footer>foot words</footer>", f"T {BODY} x."),
        (f"<article><p>{BODY}<aside>side talk</aside><p>end</article>", f"{BODY} end"),
        (f"<article><p>{BODY}</p><div class='ad'>buy this now</div><p>end</p></article><div id=comments><p>I like it</p></div>", f"{BODY} end"),
        (f"<nav><ul><li>never closed<article><p>{BODY}</p></article>", BODY),
        (f"<script>if (a<b) 'x</p>'</script><style>p{{}}</style><article>{BODY}<!-- no --><br>more</article>", f"{BODY} more"),
        (f"<article><p>{BODY} a<b>b</b>c &lt;i&gt; &copy;&nbsp;d</p></article>", f"{BODY} abc <i> © d"),
        (f"<div id='page'><div class='page-content'><p>{BODY}</p></div></div>", BODY),
        (f"<article><p>{BODY}</p></article><form><label>Mail me news</label></form><div class='cookie-notice'>we use them</div>", BODY),
        (f"<main><p>{BODY}</p><div hidden>not seen</div><div style='display: none'>nor this</div></main>", BODY),
        (f"<div class='wrap'><div class='top-nav'>x y</div><div class='story-body'><h2>T</h2><p>{BODY}</p><ul><li>a</li><li>b</li></ul></div><section class='reader-comments'><article>me too</article></section></div>", f"T {BODY} a b"),
        (f"<div>Jump to it here</div><article><p>{BODY}</p></article><div><a>Back up now</a> and some more</div>", BODY),
        (f"<div><h1>T</h1><p>{BODY}</p></div><div class='related'><article>other news</article></div>", f"T {BODY}"),
        ("<a href='x", ""),
        (f"<div class='story'><h1>T</h1><p>{BODY}</p><p>One more, see <a href='x'>this page</a></p></div><div><a href='y'>Home</a></div>", f"T {BODY} One more, see this page"),
        (f"<article><p><a href='x'>Link only</a></p><p>{BODY}</p><p>And <a>this</a></p><p><a href='y'>The source</a></p></article><div><a>Home</a></div>", f"Link only {BODY} And this The source"),
    ],
)
def test_pages(page, text):
    assert extract_text(page) == text


def test_text_beside_an_article_element_is_not_lost():
    body, teaser = " ".join(f"word{i}" for i in range(400)), " ".join(f"tease{i}" for i in range(50))
    for n in (1, 2, 8):
        cards = f'<article class="card"><h2>more</h2><p>{teaser}</p></article>' * n
        got = extract_text(f'<body><div class="post-content"><p>{body}</p></div><div class="grid">{cards}</div></body>')
        assert set(body.split()) <= set(got.split()), n
    assert extract_text(f"<div><h1>Title</h1><p>The lead.</p><article><p>{BODY}</p></article></div>") == f"Title The lead. {BODY}"


@pytest.mark.parametrize(
    "inner, text",
    [
        ("<div><p>One<p class='ad'>Buy<p>Two<p>Three</div>", "One Two Three"),
        ("<p>One</p><p class='ad'>Buy<p>Two</p><p>Three</p>", "One Two Three"),
        (f"<p class='notice'>Note <b>this<h2>One</h2><div>{BODY}</div><p>{BODY}", f"One {BODY} {BODY}"),
        ("<p class='promo'>Buy<hr>One<p>Two", "One Two"),
        ("<ul><li>One<li class='share'>Send<ul><li>this</ul><li>Two</ul><p>Three", "One Two Three"),
        ("<dl><dt>One<dd class='ad'>Buy<dt>Two<dd>Three</dl>", "One Two Three"),
        ("<table><tr><td>One<td class='ad'>Buy<td>Two<tr class='promo'><td>Buy<tr><td>Three</table>", "One Two Three"),
        ("<p>One</p><div class='ad'><p>Buy<p>now<ul><li>x<li>y</ul></div><p>Two", "One Two"),
    ],
)
def test_boxes_without_end_tags(inner, text):
    assert extract_text(f"<article><p>{BODY}</p>{inner}</article>") == f"{BODY} {text}"


def test_long_and_deep_pages():
    long = "<article>" + "<p>word &amp; word</p>" * 30_000 + "</article>"
    assert extract_text(long).count("word & word") == 30_000
    assert extract_text("<div><b>" * 50_000 + "x") == "x"


def test_articles_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op1_html_extract(spark, sf).collect()
    assert len(got) == len(source)
    for r in got:
        inner = re.search(r"<article>(.*?)</article>", source[r["page_id"]], re.S)[1]
        inner = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))
        assert r["text"] == " ".join(html.unescape(inner).split()) and r["n_chars"] == len(r["text"])


def test_labelled_pages_not_used_for_fitting():
    pages = labelled_pages(200, seed=99)
    right = sum(extract_text("".join(f for f, _ in p), default_scores()).split() == " ".join(f for f, k in p if k).split() for p in pages)
    assert right >= 170  # short unnamed lines beside the article and short unnamed divs in it look alike


def test_frame(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, "<p>x</p>", None), (2, "<p>x</p>", None)], "page_id long, html string, text string")
    got = extract(rows)
    assert got.columns == ["page_id", "text", "n_chars"]
    assert sorted(map(tuple, got.collect())) == [(1, "", 0), (2, "x", 1), (2, "x", 1)]
    assert extract(rows.limit(0)).count() == 0


def test_best_run_against_all_runs():
    rng = random.Random(5)
    for _ in range(2000):
        values = [rng.choice([-3.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]) for _ in range(rng.randrange(12))]
        runs = [(sum(values[i:j]), -i, j) for i, j in itertools.combinations(range(len(values) + 1), 2)]
        best = max(runs, default=(0, 0, 0))
        first, end = best_run(values)
        if best[0] <= 0:
            assert (first, end) == (0, 0)
        else:
            assert sum(values[first:end]) == best[0]
            assert first == min(-i for v, i, _ in runs if v == best[0])  # sums of halves are exact
            assert end == max(j for v, i, j in runs if v == best[0] and -i == first)


def plain_site(rng):
    """A page without article, main, class, id or role: only the run of words and tags tells what the article is."""
    word = lambda n: " ".join(rng.choice(["alder", "birch", "cedar", "doum", "elm", "fir"]) + str(rng.randrange(999)) for _ in range(n))
    links = lambda n: "".join(f'<div><a href="/{i}">{word(rng.randint(1, 2))}</a></div>' for i in range(n))
    parts = [word(rng.randint(25, 60)) for _ in range(rng.randint(3, 9))]
    title = word(5)
    body = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in parts)
    return f"<html><body><div>{links(rng.randint(4, 9))}</div><div>{body}</div><div>{links(rng.randint(4, 9))}</div></body></html>", " ".join([title, *parts])


def test_the_run_decides_where_no_name_does():
    rng = random.Random(12)
    right = every = 0
    for _ in range(100):
        page, text = plain_site(rng)
        right += extract_text(page) == text
        every += " ".join(t for _, t, _, _ in sequence(page, default_scores().boxes) if t).split() == text.split()
    assert every == 0 and right >= 90
