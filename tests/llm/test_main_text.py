"""Main text of pages: markup, unmarked pages by repeats, brute force over shards, odd pages."""

import random
import re
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from lodestrand.llm import boilerplate, page_blocks, queries

PAGES = "page_id long, url string, html string, host string, row long, blocks string, text string, shard int"


def extracted(spark, pages, **more):
    table = spark.createDataFrame([(i, u, h, "x", 1, "x", "x", 1) for i, u, h in pages], PAGES).repartition(3)
    return sorted(((r.page_id, r.url, r.text) for r in boilerplate.main_text(table, **more).collect()), key=repr)


def only(html):
    return "\n".join(text for what, _, text in page_blocks.blocks(html) if what == page_blocks.CONTENT)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article><h1>A  b</h1><p><b>c\n d<br><p>e&amp;f &lt;i&gt;</article><footer>x</footer>", "A b\nc d\ne&f <i>"),
        ('<body class="has-sidebar"><div class="ad">buy</div><article><p>one<!-- <p>no</p> --> two</p></article>', "one two"),
        ('<form class="page"><article><p>kept</p><form>name <input></form></article></form>', "kept"),
        ('<article>a<script>var t="</article>";</script><style>p{}</style>b</article>', "a b"),
        ('<article data-x="a>b" title=don\'t><p>x</p><div id=comments><p>said</p></div><section class="share-bar">s</section></article>', "x"),
        ("<main><p>m</p><aside>no</aside><p role=note>n</p></main>", "m\nn"),
        ("<main>out<article>in</article></main>", "in"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table></article>", "one\ntwo\na\nb\nc"),
        ("<article><p>w<i>or</i>d</p><div hidden>no</div><nav>no</nav></article>", "word"),
        ("<article><p>a &am b &copy; &#x41;&#0;", "a &am b © A�"),
        ("<aside><article>teaser</article></aside><article>main</article>", "main"),
        ("<article><p>1 < 2 and 3<4</p>", "1 < 2 and 3<4"),
        ("", ""),
    ],
)
def test_blocks(html, text):
    assert only(html) == text


def test_long_and_broken_pages():
    assert only("<article><p " + "x" * 1_000_000 + ">a</p>") == "a"
    assert only('<article><p title="' + "y" * 1_000_000 + "<p>not gone") == "not gone"
    assert len(only("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>")) == 4
    assert only("<article>" + "<p>word</p>" * 50_000).count("\n") == 49_999


def site(rng, n, host):
    """Pages of unmarked divs: a menu and a foot that some pages share, and own sentences; two pages are copies."""
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    menus, feet = ([" ".join(word() for _ in range(9)) for _ in range(3)] for _ in range(2))
    bodies = [[" ".join(word() for _ in range(12)) for _ in range(rng.randint(2, 4))] for _ in range(n)]
    bodies[1] = bodies[0]
    pages = [f'<div class="a1">{rng.choice(menus)}</div><div class="b"><p>' + "<p>".join(body) + f'</div><div class="c">{rng.choice(feet)}</div>' for body in bodies]
    return [(k, f"https://{host}/{k}", page) for k, page in enumerate(pages)], ["\n".join(body) for body in bodies]


def test_unmarked_pages(spark):
    pages, bodies = site(random.Random(5), 30, "one.example")
    for chars in (1 << 19, 900):  # one array, and one for a few pages each
        assert [text for _, _, text in extracted(spark, pages, shard_chars=chars)] == [t for _, t in sorted((((k, u), b) for (k, u, _), b in zip(pages, bodies)), key=repr)]


def test_notice_among_paragraphs(spark):
    rng = random.Random(8)
    sentence = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(12))
    own = [sentence() for _ in range(8)]
    pages = [(k, "//h/x", f"<div><p>{t}<p>sign up for our letter today</div>") for k, t in enumerate(own)]
    assert [t for _, _, t in extracted(spark, pages)] == own


def brute(pages, words=boilerplate.WORDS):
    """Dropped blocks by a table of all windows."""
    hosts, out = defaultdict(list), {}
    for k, (_, url, html) in enumerate(pages):
        blocks = page_blocks.blocks(html or "")
        if any(what == page_blocks.OPEN for what, _, _ in blocks):
            stream = [(w.lower(), no) for no, (what, _, text) in enumerate(blocks) if what != page_blocks.CONTENT for w in text.split(" ")]
            hosts[re.match(r"https?://([^/]*)", url)[1]].append((k, blocks, stream))
    for rows in hosts.values():
        held = defaultdict(set)
        for k, _, stream in rows:
            for i in range(len(stream) - words + 1):
                held[tuple(w for w, _ in stream[i : i + words])].add(k)
        paths, marks = defaultdict(lambda: [0, 0]), []
        for k, blocks, stream in rows:
            repeated, common = set(), set()
            for i in range(len(stream) - words + 1):
                n = len(held[tuple(w for w, _ in stream[i : i + words])])
                repeated |= set(range(i, i + words)) if n > 1 else set()
                common |= set(range(i, i + words)) if n > 2 and 2 * n >= len(rows) else set()
            for no, (what, path, _) in enumerate(blocks):
                at = [i for i, (_, b) in enumerate(stream) if b == no]
                if what == page_blocks.OPEN:
                    marks.append((k, no, path, len(at), len(repeated & set(at)), len(common & set(at))))
                    paths[path][0] += len(at)
                    paths[path][1] += len(repeated & set(at))
        for k, no, path, n, covered, common in marks:
            if 2 * covered >= n and (2 * paths[path][1] >= paths[path][0] or 2 * common >= n):
                out.setdefault(k, set()).add(no)
    return out


@pytest.mark.parametrize("chars", [1 << 19, 400])
def test_repeats_like_a_table_of_windows(spark, chars):
    rng = random.Random(6)
    phrases = [" ".join(rng.choices("uvw xyz the of and to it is".split(), k=rng.randint(1, 9))) for _ in range(25)]
    pages = []
    for k in range(60):
        parts = [f"<{t}>{rng.choice(phrases)} {rng.choice(['', 'N%d' % k])}</{t}>" for t in rng.choices(["div", "p", "nav", "section", "article"], [3, 3, 2, 1, 0.2], k=rng.randint(0, 7))]
        pages.append((k, rng.choice(["http://a/", "https://a/", "http://b/1", "https://c.d/"]), "".join(parts)))
    want = brute(pages)
    assert sum(map(len, want.values())) > 20
    texts = {k: "\n".join(t for no, (what, _, t) in enumerate(page_blocks.blocks(h)) if what == page_blocks.CONTENT or what == page_blocks.OPEN and no not in want.get(k, ())) for k, _, h in pages}
    assert {k: t for k, _, t in extracted(spark, pages, shard_chars=chars)} == texts


def test_nulls_repeats_and_nothing(spark):
    page = "<article><p>text</p></article><div>odd bit</div>"
    rows = [(None, None, page), (1, None, None), (1, "", ""), (2, "http://u:p@H:8/x", page), (2, "http://u:p@H:8/x", page), (3, "nonsense", "no markup at all")]
    got = extracted(spark, rows)
    assert got == sorted([(None, None, "text\nodd bit"), (1, None, ""), (1, "", ""), (2, "http://u:p@H:8/x", "text\nodd bit"), (2, "http://u:p@H:8/x", "text\nodd bit"), (3, "nonsense", "no markup at all")], key=repr)
    assert extracted(spark, []) == []


def test_query_columns(spark):
    rows = queries.op11_host_suffix_array(spark, "/root/testdata/sf0.001")
    assert rows.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]


def test_pages_whose_markup_is_hidden(spark):
    """Without article, nav and footer elements and class names no block of an article is lost, copied articles included, and most of the rest goes."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = F.col("html")
    for a, b in (("<article>", '<div class="m">'), ("<nav>", '<div class="n">'), ("<footer>", '<div class="f">'), ('class="ad"', 'class="s"'), ("</article>", "</div>"), ("</nav>", "</div>"), ("</footer>", "</div>")):
        html = F.replace(html, F.lit(a), F.lit(b))
    largest = pages.groupBy(F.regexp_extract("url", "//([^/]*)", 1).alias("host")).count().orderBy(F.desc("count")).first().host
    pages = pages.where(F.contains("url", F.lit(f"//{largest}/")))
    shown = {r.page_id: r.text.split("\n") for r in boilerplate.main_text(pages).collect()}
    hidden = {r.page_id: r.text.split("\n") for r in boilerplate.main_text(pages.withColumn("html", html)).collect()}
    assert len(shown) > 20 and all(set(shown[k]) <= set(hidden[k]) for k in shown)
