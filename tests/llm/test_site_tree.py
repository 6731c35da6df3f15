"""Main text by site style trees: templates without telling names, names, markup, and odd pages."""

import random
import re

import duckdb
from pyspark.sql import functions as F

from lakeloom.llm import site_tree as S
from tests.llm.fixtures import prose


def pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for clash in ("text", "host", "row", "blocks", "gone", "node"):
        df = df.withColumn(clash, F.lit("x"))
    return df


def texts(spark, rows, **more):
    return {r.page_id: r for r in S.extract(pages(spark, rows), **more).collect()}


def test_the_tree_alone_finds_templates(spark):
    """No element or class says what it is; two hosts with templates of their own."""
    r, rows = random.Random(1), []
    pool = [prose(9000 + i, 8) + "." for i in range(6)]
    for i in range(120):
        paragraphs = [prose(i * 10 + k, 25) for k in range(2 + i % 4)]
        told = "".join(f"<p>{p}</p>" for p in paragraphs)
        if i % 3:
            html = f"<div class='x1'><ul><li>Home<li>News<li>{r.choice(['Sport', 'Culture'])}</ul></div><div class=k{i}><div class=b>{told}</div><div class=q>{pool[i % 6]}</div></div><div class=z>All rights {pool[0]}</div>"
        else:
            html = f"<table><tr><td>{pool[i % 5]}<td><center>{told}</center></td></tr><tr><td>{pool[1]}</table>"
        rows.append((i, f"http://{'a' if i % 3 else 'B'}.example.org:80/{i}", html))
    want = {i: "\n\n".join(prose(i * 10 + k, 25) for k in range(2 + i % 4)) for i in range(120)}
    got = texts(spark, rows)
    assert {i: x.text for i, x in got.items()} == want
    assert all(x.n_tree > 0 and x.n_named == 0 and x.n_chars == len(x.text) for x in got.values())
    # the way without a broadcast gives the same
    assert {i: x.text for i, x in texts(spark, rows, small=0).items()} == want


def test_the_tree_finds_most_of_the_given_templates(spark):
    """The given pages, their elements renamed: what stays is the article's, most of the rest goes."""
    rows, kinds = [], {}
    for i, url, html in duckdb.connect().execute("SELECT page_id, url, html FROM '/root/testdata/sf0.1/pages.parquet'").fetchall():
        kinds[i] = [kind == S.KEPT for _, kind, _ in S.parsed(html)[0]]
        for name in ("nav", "article", "footer"):
            html = re.sub(rf"<(/?){name}\b", r"<\1section", html)
        rows.append((i, url, html.replace('class="ad"', 'class="k"').replace("<ul>", "<div>").replace("</ul>", "</div>").replace("li>", "p>")))
    found = S.parse(pages(spark, rows))
    removed = S.importances(found).filter(F.col("importance") < S.LEAST).select("host", "node").withColumn("low", F.lit(True))
    blocks = found.select("page_id", "host", F.posexplode("blocks")).select("page_id", "host", "pos", "col.node").join(removed, ["host", "node"], "left")
    inside = outside = lost = kept = 0
    for b in blocks.collect():
        if kinds[b.page_id][b.pos]:
            inside, lost = inside + 1, lost + bool(b.low)
        else:
            outside, kept = outside + 1, kept + (not b.low)
    assert lost <= 0.01 * inside and kept <= 0.05 * outside, (lost, inside, kept, outside)


ARTICLE = "<h1>On  the &eacute;tude</h1><p>First <b>bold<br>line</b> &amp;amp; more<p>Second &#x2014; one"


CASES = [
    (f"<nav>menu</nav><article>{ARTICLE}</article><footer>me</footer>", None),
    (f"<header><h1>Site</h1>x</header><main><article><header>{ARTICLE.split('<p>')[0]}<p>By me</p></header><p>{ARTICLE.split('<p>', 1)[1]}</article></main>", None),
    (f"<body class='has-sidebar'><div class='page-with-sidebar'><main>{ARTICLE}</main></div><aside>s</aside>", None),
    (f"<article class='post category-social'>{ARTICLE}</article><div id=comments><ol class=comment-list><li class=comment><article class=comment-body><p>Nice!</article></ol></div>", None),
    (f"<form action=/><article>{ARTICLE}<form><input value=x><button>Go</button>Your mail</form></article></form>", None),
    (f"<!-- <p>not this --><article>{ARTICLE}<script>if (a</b) x='<p>'</script><style>p{{}}</style><div hidden>h</div><div style='display: none'>h</div></article>", None),
    (f"<article>{ARTICLE}<div class='ad-box'>buy</div><ul class=share><li>a<li>b</ul></article><div class=cookie-notice>We</div>", None),
    (f"<div role=navigation>m</div><article>{ARTICLE}", None),
    ("<article></article>", ""),
    ("", ""),
    (None, ""),
    ("plain\n text<p", "plain text"),
    ("<p>a<p>b<div>c</p>d", "a\n\nb\n\nc\n\nd"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
    ("</div></p>x<unknown>y</unknown>z", "x\n\ny\n\nz"),
]


def test_names_and_markup(spark):
    """Each page on a host of its own, so that no tree says anything of it."""
    whole = "On the étude\n\nFirst bold line &amp; more\n\nSecond — one"
    got = texts(spark, [(i, f"https://u:p@h{i}.example.com?x", html) for i, (html, _) in enumerate(CASES)])
    for i, (html, want) in enumerate(CASES):
        want = whole if want is None else want
        assert (got[i].text, got[i].n_chars, got[i].url) == (want, len(want), f"https://u:p@h{i}.example.com?x"), html


def test_repeated_rows_and_copies_stay(spark):
    """The same page fetched a hundred times is no template, and neither is an article that most pages of a host carry."""
    one = (7, "http://h.example.com/1", "<div><p>" + prose(1, 40) + "</p></div>")
    copies = [(i, f"http://g.example.com/{i}", f"<div class=m{i}>menu {i % 3}</div><article><p>{prose(2, 40)}</p></article>") for i in range(100, 200)]
    got = S.extract(pages(spark, [one] * 100 + copies)).collect()
    assert [r.text for r in got if r.page_id == 7] == [prose(1, 40)] * 100
    assert {r.text for r in got if r.page_id != 7} == {prose(2, 40)}


def test_empty_table_and_nulls(spark):
    assert S.extract(pages(spark, [])).count() == 0
    got = S.extract(pages(spark, [(None, None, None), (None, "", "<p>a"), (3, "nonsense", "<p>b"), (3, "nonsense", "<p>b")])).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, ""), (0, "a"), (3, "b"), (3, "b")]


def test_long_and_hostile_pages_are_read_whole():
    long = "".join(f"<p>{prose(i, 50)}" for i in range(4000))
    assert len(S.parsed(long)[0]) == 4000
    for hostile in ("<div>" * 100_000 + "x", "<p><b>" * 50_000, "<a '" * 100_000, "<!--" * 200_000, "<li>x" * 100_000, "</div>" * 200_000, "<div><td>" * 30_000, "<b" * 200_000, "&" * 500_000, "<script>" * 100_000):
        S.parsed(hostile)
