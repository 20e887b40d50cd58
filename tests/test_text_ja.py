"""Rules under the Japanese profile, on single strings."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import html as H
from lodestrand.functions import text as X
from lodestrand.operators import candidates as C
from lodestrand.operators import feedback as B
from lodestrand.operators import verify as V
from lodestrand.profiles import JA, LATIN
from lodestrand.sources import crawl as S


def over(spark, column, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in df.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def test_sentences(spark):
    got = over(spark, lambda c: X.split_sentences(c, JA), ["「おいしい。」と評判です。", "一つ。二つ！\n三つ？残り", "", None])
    assert got == [["「おいしい。」", "と評判です。"], ["一つ。", "二つ！", "三つ？", "残り"], [], None]


def test_affixes_until_nothing_changes(spark):
    cases = {"[free] " * 40 + "text" + " (sale)" * 25: "text", "*\n" * 30 + "text [new]": "text [new]", "[free]" * 20: "", "a (b) c": "a (b) c"}
    assert over(spark, lambda c: X.strip_promo_affixes(c, LATIN), list(cases)) == list(cases.values())


def test_affixes_of_whole_texts(spark, tmp_path):
    from lodestrand.plans.queries import QUERIES

    text = "word " * 100 + "end"
    spark.createDataFrame([(i, text + " (sale)") for i in range(6)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.bare for r in QUERIES["strip_promo_affixes"](spark, str(tmp_path)).collect()}
    assert got == {0: "(new) " + text, 1: text, 2: "(plain) " + text, 3: text, 4: text, 5: text}


def test_affixes(spark):
    cases = {"【あす楽】【ポイント10倍】魚沼産の米": "魚沼産の米", "【新米】魚沼産の米": "【新米】魚沼産の米", "★ポイント10倍★米です。": "米です。", "米です。【送料無料】": "米です。", "【送料無料】": "", "米（新米）です。": "米（新米）です。"}
    assert over(spark, lambda c: X.strip_promo_affixes(c, JA), list(cases)) == list(cases.values())


def test_promotional_and_noise(spark):
    assert over(spark, lambda c: X.is_promotional(c, JA), ["価格は1,980円", "２０％オフ", "ポイント5倍", "ふっくらと炊けるお米"]) == [True, True, True, False]
    assert over(spark, lambda c: X.is_noise(c, JA), ["カートに入れる", "ABC-123", "ふっくらと炊けるお米", "トップ｜米|a|b|c"]) == [True, True, False, True]


def test_clean_text(spark):
    got = over(spark, X.clean_text, ["<p>a&nbsp;&lt;b&gt;　c</p>\r\n\r\n\r\n\r\nd\x07&eacute;", None, ""])
    assert got == ["a <b> c\n\nd" + "é", None, ""]


def test_match_key(spark):
    assert over(spark, X.match_key, ["ＡＢＣの 商品です。", "ABC の商品です。", "", None]) == ["abcの商品です。", "abcの商品です。", "", None]


def test_long_sentences_like_a_loop(spark):
    rng = random.Random(5)
    values = ["".join(rng.choices("abc ,;:.é", k=rng.randint(1, 600))).strip() for _ in range(150)]

    def loop(s):
        out = []
        while len(s) > LATIN.max_chars:
            cut = max(s[: LATIN.max_chars].rfind(c) for c in LATIN.soft_breaks)
            cut = cut if cut >= LATIN.max_chars // 3 else LATIN.max_chars - 1
            out.append(s[: cut + 1].strip())
            s = s[cut + 1 :].strip()
        return [p for p in [*out, s] if p]

    values = [v for v in values if v]
    assert over(spark, lambda c: X.split_long(c, LATIN), values) == [loop(v) for v in values]


def test_unclosed_and_nested_elements(spark):
    pages = spark.createDataFrame([(1, "<nav><nav>a</nav>b</nav>c<p class='my-ads'>d</p>e"), (2, "<div class='banner'>x"), (3, "")], "page_id long, html string")
    kept = H.without(H.html_tokens(pages), H.by_tag, H.by_role, H.by_hint).where("kind = 'text'")
    assert sorted((r.page_id, r.token) for r in kept.collect()) == [(1, "c"), (1, "e")]


@pytest.mark.parametrize(("block", "name"), [
    ('{"@type":"Product","name":"A"}', "A"), ('[{"@type":"Brand","name":"B"},{"x":{"@type":"https://schema.org/Product","name":{"@value":" C  D "}}}]', "C D"),
    ("{broken", ""), ('{"@type":"Product","name":" ","offers":{"@type":"Book","name":"E"}}', "E"),
])
def test_product_name(block, name):
    assert H.first_product_name([block]) == name


def test_charsets(spark):
    rows = [(1, "日本語".encode("cp932"), "Shift_JIS"), (2, b'<meta charset="euc-jp">' + "日本".encode("euc_jp"), "ISO-8859-1"), (3, "é".encode(), None), (4, b"\xff\xfe\xfa", None), (5, None, None)]
    got = S.charset_decode(spark.createDataFrame(rows, "page_id long, body binary, header_charset string")).orderBy("page_id").collect()
    assert [(r.html, r.used) for r in got[:3]] == [("日本語", "cp932"), ('<meta charset="euc-jp">日本', "euc_jp"), ("é", "utf-8")]
    assert got[3].used == "utf-8(replace)"
    assert got[4].html is None


def test_verification(spark):
    texts = ["米の宝石と呼ばれるブレンド米です。", "新潟県魚沼産コシヒカリを使用。", "食感が良いお米です。"]
    c = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "page_id long, pos int, text string").withColumn("match_key", X.match_key(F.col("text")))
    s = spark.createDataFrame([(1, "".join(texts))], "page_id long, source_text string")
    wanted = {"a": "新潟県 魚沼産コシヒカリを使用。", "b": "魚沼産コシヒカリ", "c": "米の宝石と呼ばれるブレンド米になります。", "d": "宇宙から来た青い石を買う。", "e": "", "f": "食感が良いお米です。新潟県魚沼産コシヒカリを使用。です"}
    q = V.keyed(spark.createDataFrame([(1, k, v) for k, v in wanted.items()], "page_id long, slot string, text string"))
    got = {r.slot: (r.text, r.method) for r in V.resolve(q, c, s, JA).collect()}
    assert got == {"a": (texts[1], "exact"), "b": ("魚沼産コシヒカリ", "contained"), "c": (texts[0], "fuzzy"), "d": ("", "none"), "e": ("", "none"), "f": (texts[1], "contained")}
    near = V.keyed(spark.createDataFrame([(1, "line2", "米の宝石と称される高級ブレンド米になります。")], "page_id long, slot string, text string"))
    assert [r.text for r in V.most_alike(near, c, 0.5, "nearest", JA).collect()] == [texts[0]]


def test_candidates_do_not_depend_on_partitions(spark):
    pages = spark.createDataFrame([(i, f"ふっくらと炊けるお米{i % 3}です。香り高い新米を使用しています。") for i in range(20)], "page_id long, body string")
    sets = [{tuple(r) for r in C.build_candidates(pages.repartition(n), JA).collect()} for n in (1, 7)]
    assert sets[0] == sets[1]
    assert len(sets[0]) == 40


def test_ring_forgets_evicted_entries():
    events = [("add", k, k) for k in "abcd"] + [("delete", "d", "x"), ("add", "b", "y")]
    assert B.fold(events, [], 3) == [("c", "c"), ("b", "y")]


def test_ring_is_folded_in_batches(spark):
    """An owner's events pass a task batch by batch, not as one group."""
    rng = random.Random(3)
    rows = [(f"{i:03}", rng.choice(["a", "b", None]), f"k{rng.randrange(14)}", i // 3, rng.choice(["add", "add", "delete"])) for i in range(200)]
    log = spark.createDataFrame(rows, "id string, owner string, key string, ts long, op string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        ring = B.feedback_ring(log, 4)
        got = {tuple(r) for r in ring.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    kept = {o: B.fold([(op, k, i) for i, w, k, _, op in rows if w == o], [], 4) for o in ("a", "b", None)}
    assert got == {(o, k, i, n) for o, entries in kept.items() for n, (k, i) in enumerate(reversed(entries), 1)}
    assert "FlatMapGroupsInPandas" not in ring._jdf.queryExecution().toString()


def test_registered_queries_with_fuzzy_and_nearest(spark, monkeypatch):
    from lodestrand.plans import queries as Q

    texts = ["The river runs past the old stone mill at night.", "Fresh bread is baked in the village every day."]
    c = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "page_id long, pos int, text string").withColumn("match_key", X.match_key(F.col("text")))
    t = spark.createDataFrame([(1, " ".join(texts))], "page_id long, source_text string")
    wanted = [(1, "line2", "Fresh bread is baked in a village each day."), (1, "line3", "A river flows by the new stone hill at noon.")]
    q = V.keyed(spark.createDataFrame(wanted, "page_id long, slot string, text string"))
    monkeypatch.setattr(Q, "verified", lambda s, d: (q, c, t))
    assert [tuple(r) for r in Q.QUERIES["resolve_pair_fuzzy"](spark, "").select("line2", "method2", "line3", "method3").collect()] == [(texts[1], "fuzzy", texts[0], "nearest")]
    assert [tuple(r) for r in Q.QUERIES["resolve_line_fuzzy"](spark, "").collect()] == [(1, texts[1], "fuzzy")]
    assert {r.value for r in Q.QUERIES["outcome_breakdown_fuzzy"](spark, "").collect()} == {"fuzzy", "nearest"}


def test_prompts_of_all_rows(spark, tmp_path, monkeypatch):
    from lodestrand.plans import queries as Q

    spark.createDataFrame([(1, i, "user", "x") for i in range(8)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    prompt = Q.QUERIES["system_prompt"](spark, str(tmp_path)).first().prompt
    assert "Example 6\n" in prompt
    assert "Example 7" not in prompt
    spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    rows = spark.createDataFrame([(1, i, "t" * 100) for i in range(120)], "page_id long, pos long, text string")
    monkeypatch.setattr(Q, "found", lambda s, d: rows)
    lines = Q.QUERIES["request_rows"](spark, str(tmp_path)).first().message.split("candidates:\n")[1].split("\n")
    fitting = [f"{i + 1}. " + "t" * 100 for i in range(120)]
    assert lines == [x for i, x in enumerate(fitting) if sum(len(y) + 1 for y in fitting[: i + 1]) <= 6000]
