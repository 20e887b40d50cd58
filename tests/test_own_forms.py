"""Texts that are their own compatibility form stay in the engine; steps of candidates are made once."""

import unicodedata

import pandas as pd
from pyspark.sql import functions as F

from lodestrand.functions import text as X
from lodestrand.operators import candidates as C
from lodestrand.profiles import LATIN


def test_own_forms_of_all_characters(spark):
    texts = [f"a{chr(c)}b" for c in range(0x11000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in (0x301, 0x3099, 0x1161, 0xFF9E)] + ["é", "é́", "が", "né à la ß", "株式 かな カナ、「本」"]
    rows = spark.createDataFrame(pd.DataFrame({"t": texts})).select("t", X.is_own_form(F.col("t")).alias("own"), X.match_key(F.col("t")).alias("k"), X.has_key(F.col("t")).alias("has")).collect()
    assert len(rows) == len(texts)
    assert not [r.t for r in rows if r.own and not unicodedata.is_normalized("NFKC", r.t)]
    assert not [r.t for r in rows if r.has != (r.k != "")]
    assert {r.t: r.own for r in rows if r.t in ("né à la ß", "株式 かな カナ、「本」", "é", "が")} == {"né à la ß": True, "株式 かな カナ、「本」": True, "é": False, "が": False}
    blanks = spark.createDataFrame(pd.DataFrame({"t": [chr(c) for c in range(0x11000) if not 0xD800 <= c < 0xE000]})).select("t", X.match_key(F.col("t")).alias("k"), X.has_key(F.col("t")).alias("has"))
    assert blanks.where("has != (k <> '')").collect() == []


def test_only_other_texts_reach_python(spark):
    """Before, every text that isn't ASCII did."""
    rows = spark.createDataFrame([("né à la ß",), ("ﬁn",), ("abc",), (None,)], "t string")
    assert [r[0] for r in rows.select(X.is_own_form(F.col("t"))).collect()] == [True, False, True, None]
    assert [tuple(r) for r in rows.select(X.match_key(F.col("t")), X.folded_key(F.col("t"))).collect()] == [("néàlaß",) * 2, ("fin",) * 2, ("abc",) * 2, (None, None)]


def test_keys_are_made_once(spark):
    rows = spark.createDataFrame([(1, 0, "Éa b"), (1, 1, "éab"), (1, 2, " 　 "), (2, 0, None), (2, 1, "ab")], "page_id long, pos long, text string")
    first = C.dedupe_sentences(rows)
    assert sorted(tuple(r) for r in first.collect()) == [(1, 0, "Éa b", "éab"), (2, 1, "ab", "ab")]
    assert first._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython [nfkc") == 1


def test_script_ratio_and_affixes_as_before(spark):
    rows = spark.createDataFrame([("ab, 12",), ("...",), ("né 1́",), ("[sale] x [free]",), ("*** a ***",), ("　★ b　",), ("(",), ("",)], "t string")
    found = rows.select(F.round(X.script_ratio(F.col("t"), LATIN), 6).alias("r"), X.strip_promo_affixes(F.col("t"), LATIN).alias("b")).collect()
    assert [r.r for r in found] == [0.5, 0.0, 0.5, 1.0, 1.0, 0.5, 0.0, 0.0]
    assert [r.b for r in found] == ["ab, 12", "...", "né 1́", "x", "a", "b", "(", ""]
