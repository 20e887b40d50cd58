"""Items within documents against a plain search, in ASCII, Japanese and repetitive texts."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import text as X
from lodestrand.operators import containment


def key(text):
    return "".join(unicodedata.normalize("NFKC", text).lower().split())


def plain(documents, items):
    out = set()
    for d, text in documents:
        folded, origin = "", []
        for i, c in enumerate(text or ""):
            if not c.isspace():
                f = unicodedata.normalize("NFKC", c).lower()
                folded, origin = folded + f, origin + [i] * len(f)
        for q, item in items:
            k = key(item or "")
            at = folded.find(k) if k else -1
            if at >= 0:
                first, last = origin[at], origin[at + len(k) - 1]
                out.add((d, q, at, first, last - first + 1))
    return out


def found(spark, documents, items):
    d = spark.createDataFrame(documents, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    return {tuple(r) for r in containment.contained(d, q).select("doc_id", "item_id", "at", "start", "size").collect()}


@pytest.mark.parametrize("letters", ["ab ", "abcdefgh \n", "あいｶﾞか゛①Ａ 　", "aéßİﬁ ½"])
def test_like_a_plain_search(spark, letters):
    rng = random.Random(letters)
    some = lambda n: "".join(rng.choices(letters, k=n))
    documents = [(k, some(rng.choice([0, 3, 40, 300]))) for k in range(40)]
    cut = [(d, i, t[i : i + rng.choice([1, 2, 3, 5, 8, 13, 40, 120])]) for d, t in documents for i in [rng.randint(0, max(0, len(t) - 1))]]
    items = [(k, t) for k, (_, _, t) in enumerate(cut)] + [(100 + k, some(rng.choice([4, 20]))) for k in range(20)]
    documents += [(90, None), (91, "  "), (92, documents[3][1])]
    items += [(200, None), (201, " "), (202, items[0][1])]
    got = found(spark, documents, items)
    assert got == plain(documents, items) and got


def test_repetitive_texts_and_nothing(spark):
    documents = [(1, "x" * 50_000 + "tail of it"), (2, "ab" * 20_000), (3, "x" * 90)]
    items = [(1, "x" * 80), (2, "x" * 70 + "tail"), (3, "ba" * 50), (4, "not there at all, anywhere in them")]
    assert found(spark, documents, items) == plain(documents, items)
    assert found(spark, documents, []) == set() and found(spark, [], items) == set()


def test_folded_key(spark):
    texts = ["ｶﾞ A", "が é", "ﾊﾟﾋﾟ", "각", "ﾡￂ", "plain", "①½ﬁ", ""]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "i int, t string").orderBy("i").select(X.folded_key(F.col("t"))).collect()]
    assert got == ["".join(unicodedata.normalize("NFKC", c).lower() for c in t if not c.isspace()) for t in texts]
