"""Steps that many queries share do each row's work once."""

import pandas as pd
from pyspark.sql import functions as F

from lodestrand.functions import html as H
from lodestrand.functions import text as X
from lodestrand.operators import verify as V
from lodestrand.plans import inputs as N
from lodestrand.profiles import LATIN


def test_a_text_is_made_once_for_all_words(spark):
    texts = spark.createDataFrame([("a.b x",), ("aXb",), (None,)], "t string")
    assert [r[0] for r in texts.select(X.contains_any(F.col("t"), ("q", "a.b"))).collect()] == [True, False, None]
    rows = spark.createDataFrame([("<div class=ad-box>", "div"), ("class=ad-box", "")], "token string, tag string")
    by_hint = rows.select(H.by_hint(F.col("token"), F.col("tag")).alias("x"))
    assert [r.x for r in by_hint.collect()] == [True, False]
    assert "exists(" not in by_hint._jdf.queryExecution().optimizedPlan().toString()


def test_blanks_and_signs_are_taken_out_once(spark):
    ratio = spark.createDataFrame([("ab, 12",), ("...",)], "t string").select(X.script_ratio(F.col("t"), LATIN).alias("r"))
    assert [r.r for r in ratio.collect()] == [0.5, 0.0]
    assert ratio._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_only_what_may_be_most_alike_is_compared():
    ratio = V.ratio_from(0.3).func
    keys, query = ["abcdefgx", "xgfedcba", "abcdefgy", "zzzzzzzz", "abcdefgh", "abcdefgh"], "abcdefgh"
    assert ratio(pd.Series([1] * 6), pd.Series(["a"] * 6), pd.Series(keys), pd.Series([query] * 6)).isna().tolist() == [True, True, True, True, False, False]
    other = ratio(pd.Series([1, 2, 2]), pd.Series(["a"] * 3), pd.Series(["abcdefgh", "abcdefgx", "abcdefgy"]), pd.Series([query] * 3))
    assert other.round(3).tolist() == [1.0, 0.875, 0.875]


def test_batches_of_pages_are_bounded(spark):
    N.pages(spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= N.BATCH_BYTES
    largest = F.pandas_udf(lambda t: pd.Series([int(t.str.len().sum())] * len(t)), "long")
    assert spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), F.lit(2000)).alias("t")).select(largest("t").alias("n")).agg(F.max("n")).first()[0] < 2 * N.BATCH_BYTES


def test_bound_of_batches_however_it_is_spelled(spark):
    """Before, a bound with a unit raised an error."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(bound)
    try:
        for said, held in (("64m", N.BATCH_BYTES), ("1g", N.BATCH_BYTES), ("67108864", N.BATCH_BYTES), ("67108864b", N.BATCH_BYTES), ("1MB", 1 << 20), ("100k", 100 << 10), ("100", 100)):
            spark.conf.set(bound, said)
            N.pages(spark, "/root/testdata/sf0.001")
            assert N.bytes_of(spark.conf.get(bound)) == held
    finally:
        spark.conf.set(bound, before)
