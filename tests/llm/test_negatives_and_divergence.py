"""Hard negatives and source divergence against brute force: nulls, ties, repeated rows, empty tables, clashing columns, several passes."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.llm import divergence, hard_negatives, transducer

VECTORS = "vec_id long, embedding array<float>, label int, id string, q string, score string, key string, row string"


def _mined(rows):
    """The contract's steps by loops."""
    usable = {}
    for i, vector, label in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None), key=repr):
        if all(x is not None and math.isfinite(x) for x in vector):
            label = (label + 1) % 10 if i % 7 == 0 else label
            row = (label, [math.floor(256 * x) for x in vector])
            usable[i] = min(usable.get(i, row), row)
    out = []
    for a in usable:
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(usable[a][1], v)), i, l == usable[a][0]) for i, (l, v) in usable.items() if i != a and len(v) == len(usable[a][1])]
        scored.sort()
        for s, p, _ in [x for x in scored if x[2]][:5]:
            window = [(n, i) for n, i, same in scored if not same and 30 * -s <= 100 * -n <= 90 * -s][:10]
            out += [(a, p, k, i, -s, -n) for k, (n, i) in enumerate(window, 1)]
    return sorted(out)


def _vectors():
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.75, 0.0]) for _ in range(4)], rng.choice([1, 1, 2, 9])) for i in range(0, 900, 5)]
    rows += [(3, [0.25, 0.5, 0.5, 0.5], 1), (3, [0.25, 0.5, 0.5, 0.5], 1), (3, [0.5, 0.5, 0.5, 0.5], 2)]  # an id that repeats
    rows += [(1, None, 1), (2, [1.0, None, 1.0, 1.0], 1), (4, [float("nan"), 1.0, 1.0, 1.0], 1), (6, [float("inf"), 1.0, 1.0, 1.0], 1), (8, [1.0] * 4, None), (None, [1.0] * 4, 1)]
    rows += [(1000, [], 1), (1001, [], 1), (1002, [], 2), (1100, [1.0, 1.0], 1), (1101, [1.0, 0.5], 1), (1102, [0.5, 0.5], 2), (1103, [300.0, 9000.0], 2), (-100, [0.25] * 4, 1)]
    return rows


@pytest.mark.parametrize("limit", [1 << 20, 64])
def test_negatives_like_loops(spark, limit):
    rows = _vectors()
    table = spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], VECTORS).repartition(5)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.mine(hard_negatives.quantised(table, "vec_id", label, "embedding"), F.col("id") % 100 == 0, limit=limit).collect()
    assert sorted(map(tuple, got)) == _mined(rows) and len(got) > 100


def test_negatives_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(hard_negatives.quantised(none, "vec_id", F.col("label"), "embedding"), F.col("id") % 100 == 0).collect() == []


def test_keys_sort_as_their_fields():
    rng = random.Random(1)
    rows = [(rng.choice([-5, 0, 3]), rng.randint(-(1 << 40), 1 << 40), rng.randint(0, 1), rng.choice([-9, 0, 7])) for _ in range(300)]
    keys = [hard_negatives.packed(*(np.array([x], np.int64) for x in r[:2]), r[2], np.array([r[3]], np.int64)) for r in rows]
    assert [(a[0], s[0], k[0], i[0]) for a, s, k, i in map(hard_negatives.unpacked, keys)] == rows
    assert [r for _, r in sorted(zip((k[0].as_py() for k in keys), rows))] == sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3]))


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for most in (200, 1 << 20, 1 << 29):
        a, b = rng.integers(-most, most, (7, 64)), rng.integers(-most, most, (9, 64))
        assert (hard_negatives.products(a, b) == a @ b.T).all()


def test_transducer_places():
    rng = random.Random(4)
    terms = sorted({b"ab" + bytes(rng.choices(b"abc\xc3\xa9", k=rng.randint(0, 6))) for _ in range(400)})
    machine = transducer.build(terms)
    words = transducer.Vocabulary([{"lang": "x", "prefix": b"ab", "first": 10} | machine, {"lang": "x", "prefix": b"q", "first": 5} | transducer.build([b"q"])])
    tried = [*terms, b"ab", b"abz", terms[7] + b"z", b"q", b"qq", b"a", b"zz", terms[3].upper().replace(b"\xc3", b"\xc3")]
    flat = np.frombuffer(b"".join(tried), np.uint8)
    ends = np.cumsum([len(t) for t in tried])
    got = words.ordinals(np.zeros(len(tried), np.int64), flat, ends - [len(t) for t in tried], ends).tolist()
    place = {t: 10 + k for k, t in enumerate(terms)} | {b"q": 5}
    assert got == [place.get(t.lower(), -1) for t in tried]
    prefixes = {t[:k] for t in terms for k in range(2, len(t) + 1)}
    right = lambda p: frozenset(t[len(p) :] for t in terms if t.startswith(p))
    assert len(machine["finals"]) == len({right(p) for p in prefixes})  # a state for each right language: minimal


def _audited(rows, min_docs, top):
    lower = {k: k + 32 for k in range(65, 91)}
    docs = [(lang or "", source or "", [w.translate(lower) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = sorted((t for t, n in held.items() if n >= min_docs), key=str.encode)
        counts = defaultdict(Counter)
        for _, source, words in (d for d in docs if d[0] == lang):
            counts[source].update(w for w in words if held[w] >= min_docs)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in counts if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


def _texts():
    rng = random.Random(9)
    words = ["alpha", "Beta", "été", "ÉTÉ", "naïve", "日本", "a", "b2b", "the", "The", "zz", "z" * 40]
    rows = [(" ".join(rng.choices(words, weights=range(1, 13), k=rng.randint(0, 30))), rng.choice(["en", "fr"]), rng.choice(["s", "t", "é", "u"])) for _ in range(60)]
    rows += [rows[0], rows[0], (None, "en", "empty"), ("", None, None), ("one two", "xx", "a"), ("three", "xx", "b"), ("long " * 30000 + "end", "fr", "s"), ("x" * 100_000, "fr", "t")]
    return rows


@pytest.mark.parametrize(("limit", "cells"), [(1 << 20, 1 << 20), (200, 7)])
def test_divergence_like_loops(spark, limit, cells):
    rows = _texts()
    table = spark.createDataFrame([(*r, "x", 1, 1) for r in rows], "text string, lang string, source string, term string, ordinal int, n int").repartition(4)
    got = divergence.audit(table, min_docs=2, top=5, limit=limit, cells=cells).collect()
    assert sorted(map(tuple, got)) == _audited(rows, 2, 5)


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


def test_shares_beyond_64_bits():
    counts = np.array([[1 << 40, 0, 5]])
    assert divergence._shares(counts, np.array([1 << 41])).tolist() == [[1 + 10**9 * (c + 1) // (1 << 41) for c in (1 << 40, 0, 5)]]
