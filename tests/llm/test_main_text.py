import numpy as np
import pytest

from lanewise.llm import main_text as M

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy now</div>{body}
<footer>&copy; {host} all of us</footer></body></html>"""


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><h1>Title</h1><p>One&nbsp;two  &amp;amp;\n three</p></article>", "Title One two &amp; three"),
        ("<article><p><b>bold<br><p>un<i>clo</i>sed</p><p>next</article>", "bold unclosed next"),
        ("<article><p>keep</p><aside>side</aside><form>f</form><div class='comments'><p>me too</p></div><p>end</p></article>", "keep end"),
        ("<div role=main><p>a</p></div><div>outside</div>", "a"),
        ("<article></article>", ""),
        ("<main><header><h1>Head</h1></header><p>x &lt; y &#233;</p><div id='cookie-notice'>ok?</div></main>", "Head x < y é"),
        ("<article><p>5 < 6 and a > b</p></article>", "5 < 6 and a > b"),
        ("<div id='content'><p>text</p><p hidden>no</p><span style='display: none'>no</span><div class='related-posts'>no</div><section aria-hidden=true>no</section><p class='additive'>adds</p></div>", "text adds"),
    ],
)
def test_article(body, text):
    assert M.main_texts([PAGE.format(body=body, host="h")]) == [text]


def test_repeated_runs_outside_of_an_article():
    boiler = "this long line stands on every single page of the whole site today"
    pages = [f"<body><div>{boiler}</div><p>{w} is what this page is about</p></body>" for w in ("one", "two", "three")]
    assert M.main_texts(pages) == [f"{w} is what this page is about" for w in ("one", "two", "three")]
    assert M.main_texts([pages[0]]) == [f"{boiler} one is what this page is about"]


def test_copies_of_an_article_stay():
    page = PAGE.format(body="<article><p>" + "the same article published in two places by the same host " * 3 + "</p></article>", host="h")
    assert len(set(M.main_texts([page, page]))) == 1
    assert M.main_texts([page, page])[0].startswith("the same article")


def test_covered_runs_against_brute_force():
    import random

    rng = random.Random(3)
    pages = [[[f"w{rng.randrange(3)}" for _ in range(rng.randrange(0, 30))] for _ in range(rng.randrange(0, 4))] for _ in range(6)]
    for run in (1, 3, 5, 8):
        flat = [[w for block in page for w in block] for page in pages]
        where = {}
        for n, page in enumerate(flat):
            for i in range(len(page) - run + 1):
                where.setdefault(tuple(page[i : i + run]), set()).add(n)
        for n, (page, masks) in enumerate(zip(flat, M.covered(pages, run), strict=True)):
            hit = set()
            for i in range(len(page) - run + 1):
                if len(where[tuple(page[i : i + run])]) > 1:
                    hit |= set(range(i, i + run))
            assert [m for block in masks for m in block] == [i in hit for i in range(len(page))], (n, run)


def test_on_spark(spark, monkeypatch):
    good = PAGE.format(body="<article><p>good text</p></article>", host="h")
    rows = [(1, "http://a.com/x", good), (1, "http://a.com/x", good), (2, None, None), (3, "nonsense", ""), (4, "https://A.com", "plain text"), (None, "http://b.com", "<p>unended"), (6, "http://c.com", "<div>" * 3000 + "deep")]
    rows += [(100 + i, "http://big.com/", PAGE.format(body=f"<article><p>page {i}</p></article>", host="h")) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host", "'y' as main_text", "1 as part")
    got = M.extract_main_text(df, ["page_id", "url"], part_bytes=2000)
    found = sorted(((r["page_id"], r["main_text"]) for r in got.collect()), key=str)
    expected = [(1, "good text"), (1, "good text"), (2, ""), (3, ""), (4, "plain text"), (None, "unended"), (6, "deep")] + [(100 + i, f"page {i}") for i in range(40)]
    assert found == sorted(expected, key=str)
    assert M.extract_main_text(df.limit(0), ["page_id"]).count() == 0


def test_repeats_over_a_large_host(spark):
    """Passages on two pages of a host count wherever its pages are, also where each page fills a part."""
    import random

    rng = random.Random(7)
    words = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    pairs = [words(12) for _ in range(15)]
    htmls = [f"<body><p>{words(60)}</p><div>{pairs[i // 2]}</div><p>{words(60)} {pairs[14 - i // 2]}</p></body>" for i in range(30)]
    htmls += [htmls[0], "<nav>only</nav>", f"<article><p>{words(5)}</p><p>{pairs[7]}</p></article>", "<p>short</p>"]
    df = spark.createDataFrame([(i, "http://big.com/", x) for i, x in enumerate(htmls)], "page_id long, url string, html string").repartition(5)
    expected = list(enumerate(M.main_texts(htmls)))
    for part_bytes in (500, 3000, 1 << 20):
        got = M.extract_main_text(df, ["page_id"], part_bytes=part_bytes)
        assert sorted((r["page_id"], r["main_text"]) for r in got.collect()) == expected
    assert not any(pair in text for pair in pairs for _, text in expected[:30]) and pairs[7] in expected[32][1]


SHAPES = [
    ("<p>Intro</p><div class='story'>teaser</div><p>the real text</p>", "Intro teaser the real text"),
    ("<div class='story'><p>the whole long text of it</p></div><div>more</div>", "the whole long text of it"),
    ("<article><h2 class='share-price'>Share price falls</h2><p>x</p></article>", "Share price falls x"),
    ("<article><p class='ad-hoc-nets'>Nets</p><p>x</p></article>", "Nets x"),
    ("<article>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</article>", "so x=2 holds"),
    ("<article><math><semantics><mi>y</mi><annotation>\\y</annotation></semantics></math></article>", "y"),
    ("<article>a<svg><text>logo</text></svg>b</article>", "a b"),
    ("<article>a</article><article>b</article>", "a b"),
    ("<article>a<article class='comment'>me too</article></article>", "a"),
    ("<main>a<section class='related-posts'>see</section>b</main>", "a b"),
    ("<main>a<div class='widget widget-2'>w</div></main>", "a"),
    ("<main>a<div class='search-results'>found</div></main>", "a found"),
    ("<div itemprop='articleBody'>a</div><div>much more text than that</div>", "a"),
    ("<div role='main'>a<div role='search'>s</div></div><p>out of it all</p>", "a"),
    ("<div class='page-header'>Site</div><p>text</p>", "text"),
    ("<article><div class='post-header'>Head</div><p>text</p></article>", "Head text"),
    ("<header>Site</header><p>text</p><footer>f</footer>", "text"),
    ("<article><header><h1>H</h1></header>t<footer>by me</footer></article>", "H t"),
    ("<article><ul><li>one<li>two</ul></article>", "one two"),
    ("<article><table><tr><td>1</td><td>2</td></tr></table></article>", "1 2"),
    ("<article><pre>a\n   b\tc</pre></article>", "a b c"),
    ("<article>a<br>b<hr>c<img alt='d'>e</article>", "a b ce"),
    ("<article>a<!-- x > y --> b<!doctype z> c<?php 1 ?></article>", "a b c"),
    ("<article>&lt;b&gt; &amp;lt; &#x41;&nbsp;&eacute;&notanentity;</article>", "<b> &lt; A é¬anentity;"),
    ("<article>1 < 2 <3 a<b</article>", "1 < 2 <3 a<b"),
    ("<article>a<script>if (1 < 2) '</p>'</script>b<style>p{}</style></article>", "a b"),
    ("<article>a<noscript>off</noscript><textarea>t</textarea><template>u</template></article>", "a"),
    ("<article>a<script>never ended</article><p>gone", "a"),
    ("<article>a<!-- never ended</article>", "a"),
    ("<article>a</b></i></div>b</p>c</article>", "ab c"),
    ("<article><b>a<p>b</b>c</article>d", "a bc"),
    ("<article><p>a<div>b</div>c</p></article>", "a b c"),
    ("<article><a title=\"x > y\" href='/z'>a</a>b</article>", "ab"),
    ("<ARTICLE><P>Upper</P><ASIDE>no</ASIDE></ARTICLE>", "Upper"),
    ("<article><p hidden>no</p><p data-hidden-by='x'>yes</p></article>", "yes"),
    ("<article><div style='color:red;display:none'>no</div><div style='display:block'>yes</div></article>", "yes"),
    ("<article/><p>self-closed</p>", "self-closed"),
    ("<nav>only</nav>", ""),
    ("<div class='cookie-consent-banner'>ok?</div>", ""),
    ("<div id='comments'><p>c</p></div><div class='content'><p>t</p></div>", "t"),
    ("no markup at all", "no markup at all"),
]


@pytest.mark.parametrize(("page", "text"), SHAPES)
def test_page_shapes(page, text):
    assert M.main_texts([page]) == [text]


def test_odd_markup_in_linear_time():
    import time

    for page in ("<i></b>" * 150_000, "<b><article>" + "<i>x</b>" * 120_000, "<i>" * 100_000 + "<div></div>" * 50_000, "<!" * 500_000, "<a '" * 250_000, "<article>" * 60_000 + "</p>" * 60_000):
        began = time.process_time()
        M.blocks(page)
        assert time.process_time() - began < 5, page[:20]


def site(rng, n, boiler, copies=0):
    """Pages with boilerplate inside the article, in its own words, some in another order; copies of one article at the end."""
    text = lambda k: " ".join(f"v{rng.randrange(10**6)}" for _ in range(k))
    bodies = [text(40) for _ in range(n)] + [text(40)] * copies
    made = []
    for i, b in enumerate(bodies):
        cut = i % 40
        words = b.split()
        made.append((" ".join(words), PAGE.format(body=f"<article><p>{' '.join(words[:cut])}</p><p>{boiler}</p><p>{' '.join(words[cut:])} ({i})</p></article>", host="h") if i % 7 else PAGE.format(body=f"<article><p>{b} ({i})</p></article>", host="h")))
    return [(f"{b} ({i})", page) for i, (b, page) in enumerate(made)]


BOILER = "more of this in our letter that you can have each week"


def test_template_inside_of_articles(monkeypatch):
    import random

    made = site(random.Random(1), 12, BOILER)
    assert M.main_texts([p for _, p in made]) == [t for t, _ in made]
    # Two pages are no template, and neither is a passage on fewer than half of the pages.
    assert all(BOILER in t for t in M.main_texts([made[1][1], made[2][1]]))
    some = [p.replace(BOILER, f"w{i}") if i > 4 else p for i, (_, p) in enumerate(made)]
    assert sum(BOILER in t for t in M.main_texts(some)) == 4
    # Without the array nothing goes.
    monkeypatch.setattr(M, "covered_by", lambda page, repeated, run=8: [np.zeros(len(b), bool) for b in page])
    assert sum(BOILER in t for t in M.main_texts([p for _, p in made])) == 10


@pytest.mark.parametrize("most", [1 << 19, 0])
def test_template_on_spark(spark, monkeypatch, most):
    """The same for any size of parts, pages alike count once, and where tables are joined by shuffles."""
    import random

    from lanewise.llm import _store

    monkeypatch.setattr(M, "MOST_BROADCAST", most)
    monkeypatch.setattr(_store, "MOST_BROADCAST", most)
    rng = random.Random(2)
    hosts = {"a": site(rng, 14, BOILER), "b": site(rng, 10, BOILER, copies=9), "c": site(rng, 2, BOILER), "d": site(rng, 3, "x y")}
    hosts["a"] += [hosts["a"][1]] * 30
    rows = [(f"{h}{i}", f"https://{h}.org/{i}", page) for h, made in hosts.items() for i, (_, page) in enumerate(made)]
    expected = sorted((f"{h}{i}", t) for h, made in hosts.items() for i, t in enumerate(M.main_texts([p for _, p in made])))
    assert sum(BOILER in t for _, t in expected) == 1
    df = spark.createDataFrame(rows, "page_id string, url string, html string").repartition(5)
    for part_bytes in (400, 1 << 20) if most else (400,):
        assert sorted(map(tuple, M.extract_main_text(df, ["page_id"], part_bytes=part_bytes).collect())) == expected


def test_query_against_a_plain_reading(spark):
    """The given pages have one article each, in simple markup: tags of blocks are spaces, others nothing."""
    import html
    import re

    from lanewise.llm.queries import op4_html_extraction

    folder = "/root/testdata/sf0.01"
    expected = []
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        inner = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        inner = re.sub("</?(?:p|h1|h2|br|ul|li|div)[^>]*>", " ", re.sub("<!--.*?-->", "", inner, flags=re.S))
        text = " ".join(html.unescape(re.sub("<[^>]*>", "", inner)).split())
        expected.append((r["page_id"], r["url"], text, len(text)))
    assert len(expected) > 200
    got = op4_html_extraction(spark, folder)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in got.schema] == ["page_id bigint", "url string", "text string", "n_chars bigint"]
    assert sorted(map(tuple, got.collect())) == sorted(expected)
