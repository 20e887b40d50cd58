"""Corpus operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrand.llm import bpe, components, decontamination, near_duplicates, pu, quality, queries, repeats, secret_scan, sharding, toxicity, winnowing
from lodestrand.llm.buffers import flat_utf8
from lodestrand.llm.run_length_index import RunLengthIndex, laid_out

from ..compare import difference

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, n_tokens string, score string, shard string, node string, key string"


def documents(spark, texts, sources=None):
    """Rows with columns whose names the operators use themselves."""
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[k], None, "x", "x", "x", "x", "x", "x") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "été", "naïve", "日本", "x" * 30, "a1b2", "the", "of"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 120))) + rng.choice(["", ".", "\n", "  "]) for _ in range(40)]
    texts += [None, "", " \n\t", "<|endoftext|>a <|endoftext|>", texts[0], texts[1].upper(), "long " * 20000, "é" * 300]
    return list(enumerate(texts))


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert difference(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], "/root/testdata/sf0.001") == ""


def test_terms(spark):
    texts = ["Nonsensed nonsenses nonsens", "abcdefghi abcdefg", "", "12 _ été"]
    got = [set(r.terms) for r in toxicity.with_terms(spark.createDataFrame(list(enumerate(texts)), "i int, text string").orderBy("i")).orderBy("i").collect()]
    assert got == [toxicity.terms_in(t) for t in texts]
    assert got[:3] == [{"nonsensed", "nonsenses", "nonsens", "nonsens*", "nonsens**"}, {"abcdefghi", "abcdefg", "abcdefg*"}, set()]
    assert toxicity.family_in("one two, three four") == toxicity.family_in("ONE two three four") and toxicity.family_in("") == 0


def test_bpe_like_the_library(spark, mixed):
    t = library()
    rows = [*mixed, mixed[3], (None, "null id")]
    path = queries.tokenizer_path()
    got = sorted(((r.doc_id, list(r.ids), r.text) for r in bpe.decode(bpe.encode(documents(spark, rows), path), path).collect()), key=repr)
    want = sorted(((i, e := t.encode(x or "", add_special_tokens=False).ids, t.decode(e, skip_special_tokens=False)) for i, x in rows), key=repr)
    assert got == want
    counts = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in bpe.count_tokens(documents(spark, rows), path, frequent=16, cache_words=8).collect()), key=repr)
    assert counts == sorted(((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows), key=repr)


def test_one_very_long_word(spark):
    t, path = library(), queries.tokenizer_path()
    rng = random.Random(5)
    word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=150_000))
    docs = spark.createDataFrame([(1, word), (2, "a " + word)], "doc_id long, text string")
    want = {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in ((1, word), (2, "a " + word))}
    assert {r.doc_id: r.n_tokens for r in bpe.count_tokens(docs, path).collect()} == want
    assert {r.doc_id: r.text for r in bpe.round_trip(docs, path).collect()} == {1: word, 2: "a " + word}


@pytest.mark.parametrize("name", ["op5_token_counts", "op7_bpe_round_trip"])
def test_token_queries_like_the_library(spark, name):
    t, path = library(), "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.QUERIES[name](spark, path).collect()}
    rows = queries.table(spark, path, "documents").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids, g = t.encode(r.text or "", add_special_tokens=False).ids, got[r.doc_id]
        assert g.n_tokens == len(ids)
        if name == "op5_token_counts":
            assert (g.n_bytes, g.over_limit) == (len((r.text or "").encode()), len(ids) > 1024)
        else:
            text = t.decode(ids, skip_special_tokens=False)
            assert (g.ids_sha256, g.decoded_sha256) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), text))


def test_bpe_fuzz():
    t, v = library(), bpe.vocabulary(queries.tokenizer_path())
    rng = random.Random(2)
    alphabet = list("aab  \n\t'st1²³Ⅷé漢字かな😀.-<|>\x1c\x85\xa0　ß٣́")
    for _ in range(400):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 60)))
        flat, ends = flat_utf8(pa.array([text, text[::-1]]))
        ids, cuts = bpe.encoded(flat, ends, bpe.WordCache(v))
        assert ids[: cuts[1]].tolist() == t.encode(text, add_special_tokens=False).ids
        assert ids[cuts[1] :].tolist() == t.encode(text[::-1], add_special_tokens=False).ids


@pytest.mark.parametrize("table", ["documents"])
def test_empty_tables(spark, table):
    none = documents(spark, [(1, "x")]).where("1 = 0")
    items = spark.createDataFrame([], "item_id string, text string")
    path = queries.tokenizer_path()
    assert bpe.encode(none, path).count() == bpe.count_tokens(none, path).count() == 0
    assert near_duplicates.classes(none).count() == repeats.remove_repeats(none).count() == secret_scan.scan(none).count() == 0
    assert sharding.reshard(none, F.lit(0)).count() == winnowing.with_next(none).count() == 0
    assert decontamination.phrase_matches(none, items).count() == 0
    some = decontamination.phrase_matches(documents(spark, [(1, "a b"), (2, None)]), items).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in some) == [(1, 2, 0, []), (2, 0, 0, [])]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for operator, base in ((toxicity, 0.0), (quality, 0.5)):
        model = operator.train(none, labels, F.lit(True))
        assert [r.score for r in operator.score(documents(spark, [(1, None)]), model).collect()] == [base]


def brute_repeats(rows, width):
    seen, out = {}, []
    for i, t in sorted(((-1 if i is None else i, t) for i, t in rows), key=lambda r: r[0]):
        b = (t or "").encode()
        gone = [False] * (len(b) + 1)
        for s in range(len(b) - width + 1):
            first = seen.setdefault(b[s : s + width], (i, s))
            if first != (i, s):
                gone[s : s + width] = [True] * width
        out.append((i, bytes(x for x, g in zip(b, gone, strict=False) if not g), sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))))
    return sorted(out)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeats(spark, mixed, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_FRAGMENTS", hot)
    rng = random.Random(4)
    line = "".join(rng.choices("abcdefgh ", k=150))
    rows = [*mixed, *((100 + k, "".join(rng.choices("abcdefgh ", k=rng.randint(0, 90))) + line[k % 7 :] + "".join(rng.choices("abcdefgh ", k=80))) for k in range(25)), (None, line), (300, "ab" * 200)]
    got = sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.kept), len(r.spans)) for r in repeats.remove_repeats(documents(spark, rows)).collect())
    assert got == brute_repeats(rows, 100)
    again = repeats.remove_repeats(documents(spark, [(1, line), (1, line), (2, line)])).collect()
    assert sorted((r.doc_id, len(r.kept)) for r in again) == [(1, 150), (1, 150), (2, 0)]
    other = "".join(rng.choices("ijklmnop ", k=150))
    two = repeats.remove_repeats(documents(spark, [(1, line), (5, line), (5, other), (6, other), (None, "zz"), (None, other + "zz")])).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, len(r.kept)) for r in two) == [(0, 2, 2), (0, 152, 152), (1, 150, 150), (5, 150, 0), (5, 150, 0), (6, 150, 0)]


def test_fragments_that_share_a_window_agree_on_a_side():
    rng = random.Random(8)
    shared = "".join(rng.choices("abcd ", k=400))
    texts = []
    for _ in range(40):
        a, k = rng.randrange(300), rng.randint(100, 140)
        texts.append(("".join(rng.choices("efgh ", k=rng.randint(0, 200))) + shared[a : a + k] + "".join(rng.choices("ijkl ", k=rng.randint(0, 200)))).encode())
    texts.append(shared.encode() * 400)
    groups = defaultdict(list)
    for t in texts:
        data = np.frombuffer(t, np.uint8)
        for anchor, _, start, windows, left, right in zip(*(x.tolist() for x in repeats.fragments_of(data)), strict=True):
            groups[anchor].append(({t[s : s + 100] for s in range(start, start + windows)}, left, right))
    met = 0
    for group in groups.values():
        for k, (x, left, right) in enumerate(group[:60]):
            for y, other_left, other_right in group[:k]:
                if x & y:
                    met += 1
                    assert left == other_left or right == other_right
    assert met > 100


def laid(fragments):
    return np.frombuffer(b"".join(fragments), np.uint8).astype(np.int64), np.concatenate(([0], np.cumsum([len(f) for f in fragments])))


def test_run_length_index():
    """Matching statistics of streamed texts, from runs and samples, against a search in every indexed text."""
    rng = random.Random(3)
    for _ in range(80):
        letters = rng.choice([b"ab", b"ab\xff", b"a", b"abcdefgh\x00"])
        some = lambda n: [bytes(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(n)]
        indexed, streamed = some(rng.randint(1, 8)), some(rng.randint(1, 6)) + [b"zz"]
        text = laid_out(*laid(indexed))
        index = RunLengthIndex(text)
        assert not [k for k, x in vars(index).items() if isinstance(x, np.ndarray) and len(x) != index.runs]  # nothing is as long as the text
        symbols, ends = laid(streamed)
        want = [max(k for k in range(len(f) - i + 1) if any(f[i : i + k] in x for x in indexed)) for f in streamed for i in range(len(f))]
        assert index.statistics(symbols, ends, text).tolist() == want


def test_runs_of_copies():
    rng = random.Random(1)
    one = bytes(rng.choices(b"abcdefgh ", k=150))
    copies = RunLengthIndex(laid_out(*laid([one] * 300)))
    other = RunLengthIndex(laid_out(*laid([bytes(rng.choices(b"abcdefgh ", k=150)) for _ in range(300)])))
    assert copies.n == other.n and copies.runs < 160 and other.runs > 30_000 and copies.bytes < other.bytes / 200


def test_windows_of_earlier_fragments():
    """Every round and tag against sets of windows, with fragments cut by their anchors from shared and edited passages."""
    rng = random.Random(12)
    passages = [bytes(rng.choices(b"abcd ", k=260)) for _ in range(4)]
    rows = []
    for _ in range(120):
        p = bytearray(rng.choice(passages))
        for _ in range(rng.randint(0, 4)):
            p[rng.randrange(len(p))] = 120
        data = np.frombuffer(bytes(p[rng.randrange(80) :]), np.uint8)
        anchor, _, start, windows, _, _ = repeats.fragments_of(data)
        rows += [(a, bytes(data[s : s + w + 99])) for a, s, w in zip(anchor.tolist(), start.tolist(), windows.tolist())]
    ends, marks = repeats._repeated_inside(np.array([a for a, _ in rows]), [b for _, b in rows], 100)
    seen, want = set(), []
    for _, body in rows:
        own = [body[i : i + 100] for i in range(len(body) - 99)]
        want += [w in seen for w in own]
        seen |= set(own)
    assert marks.tolist() == want and 0 < sum(want) < len(want)
    assert ends.tolist() == np.cumsum([0] + [len(b) - 99 for _, b in rows]).tolist()


def brute_phrases(docs, items, width=13):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall((t or "").translate(low))
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    out = []
    for i, t in docs:
        w = word.findall((t or "").translate(low))
        hit, met = [0] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    met |= found
                    hit[k : k + n] = [1] * n
        out.append((i, len(w), sum(hit), sorted(met)))
    return sorted(out, key=repr)


def test_decontamination(spark, mixed):
    rng = random.Random(8)
    item = " ".join(f"Word{k}" for k in range(30))
    items = [("1", item), ("2", "short item"), ("3", None), ("4", "..."), ("2", "short item"), ("5", "été naïve 日本"), ("6", " ".join(["the of"] * 10))]
    docs = [*mixed, (200, "x " + item.upper() + " y"), (201, " ".join(item.split()[4:20])), (202, " ".join(item.split()[4:16])), (203, "a short, ITEM!"), (204, "the of " * 40), mixed[2], (None, item)]
    rng.shuffle(docs)
    table = spark.createDataFrame(items, "item_id string, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in decontamination.phrase_matches(documents(spark, docs), table).collect()), key=repr)
    assert got == brute_phrases(docs, items)


def test_proximity(spark):
    items = spark.createDataFrame([("1", "rare1 a b c rare2")], "item_id string, text string")
    docs = documents(spark, [(1, "rare1 a b c rare2"), (2, "rare1 a b c d e rare2"), (3, "rare1 " + "z " * 20 + "rare2 a b c"), (4, None), (5, "a b c a b c")])
    got = {slop: sorted(r.doc_id for r in decontamination.proximity_matches(docs, items, slop).collect()) for slop in (0, 2)}
    assert got == {0: [1], 2: [1, 2]}


def shingles(text, n):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def brute_classes(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    least = {}
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min((x for x in (least.get(root(k)), i) if x is not None), default=None)
    return sorted(((i, len(s), least[root(k)]) for k, (i, s) in enumerate(sets)), key=repr)


def test_near_duplicates(spark, mixed, monkeypatch):
    monkeypatch.setattr(near_duplicates, "LIST", 4)
    monkeypatch.setattr(near_duplicates, "HOT_COPIES", 3)
    rng = random.Random(6)
    base = [rng.choices("abcdefghijklmnopqrstuvwxyz", k=80) for _ in range(3)]
    rows = list(mixed)
    for k in range(60):
        words = list(base[k % 3])
        for _ in range(k % 5):
            words[rng.randrange(80)] = "edit%d" % rng.randrange(1000)
        rows.append((100 + k, " ".join(words)))
    rows += [(500, "one"), (501, "One"), (502, "two words"), (None, "two words"), mixed[4], (7, "another text of id 7"), (8, rows[-1][1]), (None, "no id"), (None, "no id")]
    for n, percent in ((3, 85), (5, 80)):
        found = near_duplicates.classes(documents(spark, rows), n, percent).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == brute_classes(rows, n, percent)
        assert sum(r.leading for r in found if r.n_shingles) == len(set(brute_roots(rows, n, percent)))


def brute_roots(rows, n, percent):
    """The number of the class of each text with words."""
    numbered = brute_classes([(k, t) for k, (_, t) in enumerate(rows)], n, percent)
    return [c for _, size, c in numbered if size]


@pytest.mark.parametrize("wide", [1024, 48])
def test_cells_link_what_pairs_link(monkeypatch, wide):
    """A cell's tree joins the parts that single pairs join; pairs of sets that don't come whole are left over, no link among them missing."""
    monkeypatch.setattr(near_duplicates, "WIDE", wide)
    monkeypatch.setattr(near_duplicates, "COLUMNS", 64)
    rng = np.random.default_rng(3)
    base = rng.choice(10_000, 60, replace=False)
    sets = [np.unique(np.concatenate((base[: 60 - rng.integers(0, 12)], rng.choice(10_000, rng.integers(0, 4)) + 20_000))) for _ in range(60)]
    part = [k % 7 if k % 3 == 0 else k for k in range(60)]
    rows = [(1, 0, 0, side, k, len(x), part[k], part[k] != 0, x[:wide].tolist()) for side in (0, 1) for k, x in enumerate(sets) if side or part[k]]
    names = ["list", "row", "column", "side", "node", "n", "part", "outside", "values"]
    batch = pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*rows, strict=True)], names)
    out = near_duplicates.cell_links([batch.slice(0, 31), batch.slice(31)], 85).to_pylist()
    links = {(a, b) for a in range(60) for b in range(a + 1, 60) if part[a] != part[b] and 100 * len({*sets[a]} & {*sets[b]}) >= 85 * len({*sets[a]} | {*sets[b]})}
    whole = {(a, b) for a, b in links if max(len(sets[a]), len(sets[b])) <= wide}

    def classes(pairs):
        names, least = near_duplicates._joined_parts(*(np.array([p[i] for p in pairs], np.int64) for i in (0, 1)))
        return dict(zip(names.tolist(), least.tolist(), strict=True))

    tree = {(r["a"], r["b"]) for r in out if r["sure"]}
    assert classes(tree) == classes({(part[a], part[b]) for a, b in whole})
    assert len(tree) < 60
    left = {(r["a"], r["b"]) for r in out if not r["sure"]}
    joined = classes(tree)
    assert {(a, b) for a, b in links - whole if joined.get(part[a], part[a]) != joined.get(part[b], part[b])} <= left
    assert bool(left) == (wide == 48)


def test_near_copies_that_share_a_passage(spark):
    """More members than a short list holds, and a passage of all groups that most lists come from."""
    rng = random.Random(7)
    passage = " ".join(f"p{i}" for i in range(160))
    rows, groups = [], 60
    for g in range(groups):
        own = [f"g{g}w{i}" for i in range(80)]
        for j in range(20):
            words = list(own)
            words[rng.randrange(80)] = f"x{g}y{j}"
            rows.append((g * 20 + j, " ".join(words) + " " + passage))
    rng.shuffle(rows)
    found = near_duplicates.classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert {r.doc_id: r.component_id for r in found.collect()} == {i: i // 20 * 20 for i, _ in rows}


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 3), (7, 6), (6, 7), (9, 3), *((20 + k, 21 + k) for k in range(15))]
    got = {(r.node, r.component) for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(n, 1) for n in (1, 2, 3, 9)} | {(6, 6), (7, 6)} | {(k, 20) for k in range(20, 36)}


def test_winnowing(spark, mixed):
    rows = [*mixed, (7000, "tie " * 60)]
    got = winnowing.fingerprint(winnowing.with_next(documents(spark, rows), parts=4), ["text", "next_text"]).collect()
    ordered = [t or "" for _, t in sorted(rows)]
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(sorted(rows)):
        want = winnowing.pack(*winnowing.winnow(np.frombuffer((t or "").encode(), np.uint8)))
        assert by_id[i].text_fingerprint == want
        after = ordered[(k + 1) % len(ordered)]
        assert by_id[i].next_text_fingerprint == winnowing.pack(*winnowing.winnow(np.frombuffer(after.encode(), np.uint8)))
    data = np.frombuffer("".join(random.Random(1).choices("ab", k=400)).encode(), np.uint8)
    hashes = winnowing.kgram_hashes(data, 5)
    assert len({bytes(data[k : k + 5]) for k in range(396)}) == len(set(hashes.tolist()))
    picked, top = [], hashes >> np.uint64(32)
    for a in range(len(top) - 8 + 1):
        p = max(k for k in range(a, a + 8) if top[k] == top[a : a + 8].min())
        if not picked or picked[-1] != p:
            picked.append(p)
    assert winnowing.winnow(data, 5, 8)[1].tolist() == picked


def test_resharding(spark, mixed):
    rows = [*mixed, mixed[1], (None, "null id")]
    docs = documents(spark, rows, ["hot" if k % 3 else f"s{k}" for k in range(len(rows))])
    old = F.pmod(F.crc32(F.col("source").cast("binary")), F.lit(4)).cast("int")
    for law in ("bytes", "rows"):
        got = sharding.reshard(docs, old, 4, law, blocks=8).collect()
        assert len(got) == len(rows)
        weight = [sum(r["size"] if law == "bytes" else 1 for r in got if r["shard"] == k) for k in range(4)]
        assert max(weight) - min(weight) <= (1 if law == "rows" else 2 * max(r["size"] for r in got))
        for k in range(4):
            slots = sorted(r["slot"] for r in got if r["shard"] == k)
            assert slots == list(range(len(slots)))
        assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)


def test_least_flow():
    rng = random.Random(9)
    for _ in range(30):
        n = rng.randint(1, 5)
        supply = [rng.randint(0, 50) for _ in range(n)]
        capacity = sharding.equal_capacities(sum(supply), n)
        flow = sharding.min_cost_flow(supply, capacity, [[int(i != j) for j in range(n)] for i in range(n)])
        assert [sum(f) for f in flow] == supply
        assert all(sum(f[j] for f in flow) <= capacity[j] for j in range(n))
        assert sum(flow[i][j] for i in range(n) for j in range(n) if i != j) == sum(max(0, s - c) for s, c in zip(supply, capacity, strict=True))
    with pytest.raises(ValueError):
        sharding.min_cost_flow([3], [2], [[0]])


def test_rewrite_affected(spark, tmp_path):
    """Null ids, repeated rows and ids, columns named as ours, and old shards that the new ones lack."""
    rows = [(i, "x" * (5 + i)) for i in range(30)] + [(None, "no id"), (None, "no id"), (None, None), (3, "other text"), (4, "x" * 9)]
    docs = documents(spark, rows)
    for k, (old, shards) in enumerate(((F.lit(0), 3), (F.pmod(F.length("text"), F.lit(16)) + 100, 4), (F.coalesce("doc_id", F.lit(7)) % 2, 5))):
        placed = sharding.reshard(docs, old, shards)
        path = str(tmp_path / f"out{k}")
        affected = sharding.rewrite_affected(docs, placed, path)
        back = spark.read.parquet(path)
        assert {"shard_before", "node"} <= set(back.columns)
        want = sorted(((r.doc_id, r.size, r.shard, r.slot) for r in placed.collect() if r.shard in affected), key=repr)
        assert sorted(((r.doc_id, len(r.text or "") + 1, r.shard, r.slot) for r in back.collect()), key=repr) == want
        assert len({(x[2], x[3]) for x in want}) == len(want)
        if k < 2:
            assert len(want) == len(rows)
    assert sharding.rewrite_affected(docs, sharding.reshard(docs, F.lit(0), 1), str(tmp_path / "none")) == []


def test_rewrite_affected_with_our_names(spark, tmp_path):
    """Columns named as the operator's own; and rows that agree in id, size and checksum but not in text keep a place each."""
    a, b = "plumless", "buckeroo"  # of one CRC-32
    assert zlib.crc32(a.encode()) == zlib.crc32(b.encode())
    rows = [(1, a, 7, 8, "x", 9, 1), (1, b, 7, 8, "y", 9, 2), (2, "else", 7, 8, "z", 9, 3), (None, None, 7, 8, None, 9, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, shard_before int, _id string, Slot int, _twin int")
    placed = sharding.reshard(docs, F.lit(0), 3)
    affected = sharding.rewrite_affected(docs, placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {"doc_id", "text", "shard", "slot", "shard_before", "shard_before_before", "_id", "Slot_before", "_twin"}
    want = sorted((r.shard, r.slot) for r in placed.collect() if r.shard in affected)
    got = back.collect()
    assert sorted((r.shard, r.slot) for r in got) == want and len({r._twin for r in got}) == len(got)
    assert {(r._twin, r.text, r["_id"]) for r in got} <= {(r[6], r[1], r[4]) for r in rows}


def test_resharding_query(spark):
    path = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in queries.table(spark, path, "documents").collect()}
    got = queries.op9_flow_resharding(spark, path).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs.items()}
    sizes = [sum(r.size for r in got if r.shard == k) for k in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in got)
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got))) for k in range(8))
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_winnowing_query(spark):
    path = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text or "") for r in queries.table(spark, path, "documents").collect())
    got = {r.doc_id: r for r in queries.op4_winnowing(spark, path).collect()}
    assert len(got) == len(docs)

    def chosen(text):
        return winnowing.winnow(np.frombuffer(text.encode(), np.uint8))

    def likeness(a, b):
        x, y = (set(chosen(t)[0].tolist()) for t in (a, b))
        return len(x & y) / len(x | y) if x | y else 1.0

    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (winnowing.pack(*chosen(text)), winnowing.pack(*chosen(edited)))
        assert (r.near_edited, r.near_next) == (likeness(text, edited), likeness(text, after))


@pytest.mark.parametrize(("name", "mod", "held"), [("op1_toxicity", 4, 2), ("op8_quality", 5, 0)])
def test_score_queries(spark, name, mod, held):
    path = "/root/testdata/sf0.001"
    got = queries.QUERIES[name](spark, path).collect()
    assert len(got) == queries.table(spark, path, "documents").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def brute_spans(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
    spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_secrets(spark, mixed):
    live = "9f" * 16
    texts = [f'é api_key = "{live}" end', "secret=token: abcdefgh", "PASSWORD: hunter2x token=abc", "AKIA" + "B2" * 10 + " AKIAAKIA", f"token={'ab1' * 12} " * 300, f"token=copy{'7' * 5}a", f"token=copy{'7' * 5}a"]
    rows = [*mixed, *((100 + k, t) for k, t in enumerate(texts)), (None, texts[0])]
    docs = documents(spark, rows, ["a"] * len(mixed) + ["a", "a", "a", "a", "b", "c", "d", "a"])
    found = secret_scan.scan(docs, repository_col="source").withColumn("all", secret_scan.joined(secret_scan.all_spans(F.col("base"), F.col("owned"))))
    got = {r.doc_id: r for r in found.collect()}
    for i, t in rows:
        assert [(s.start, s.kind, s.end) for s in got[i].base] == brute_spans(t or "")
    assert [(s.start, s.end) for s in got[100].owned] == [(texts[0].index(live), texts[0].index(live) + 32)]
    assert "owned:" in got[100]["all"]
    assert got[105].owned == got[106].owned == []
    red = docs.where("doc_id = 100").join(found.select("doc_id", "owned"), "doc_id").select(secret_scan.redacted(F.col("text"), F.col("owned"))).first()[0]
    assert red == 'é api_key = "[SECRET]" end'


def test_secrets_of_one_owner_in_many_documents(spark):
    import corpus_pipeline

    texts = [(i, f"text {i} token=q1w2e3r4t5y6 end") for i in range(5)] + [(i, f"text {i} token=z9x8c7v6b5n4 end") for i in range(5, 8)]
    left = corpus_pipeline.put_out_secrets(spark, documents(spark, texts, ["a"] * 5 + ["a", "b", "b"]), "").collect()
    assert {r.doc_id: r.text for r in left} == {i: f"text {i} token=[SECRET] end" if i < 5 else t for i, t in texts}


def auc(y, s):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    y = np.array(y, bool)
    return (rank[y].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (~y).sum())


def test_learned_scores(spark):
    rng = random.Random(12)
    plain = ["river", "house", "green", "walk", "stone", "paper", "light", "water", "garden", "window", "forest", "bridge"]
    rows, labels = [], []
    for i in range(1200):
        words = rng.choices(plain, k=rng.randint(5, 60))
        toxic, good = i % 7 == 0, i % 5 != 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vilified", "scoundrel"])
        text = " ".join(words) if good else " ".join(w + "$$$" for w in words)
        rows.append((i, text))
        if i % 2:
            labels.append((i, int(good), int(toxic)))
    docs, known = documents(spark, [*rows, (None, None)]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for operator, column, mod, held in ((toxicity, "toxic", 4, 2), (quality, "quality", 5, 0)):
        out = queries.scored(docs, known, operator, queries.text_crc() % mod == held).collect()
        score = {r.doc_id: r.score for r in out}
        truth = {i: x for i, q, t in labels for x in [t if column == "toxic" else q]}
        held_ids = [i for i in truth if zlib.crc32(str(i).encode()) % mod == held]
        assert len(out) == 1201
        assert all(0 <= s <= 1 for s in score.values())
        assert auc([truth[i] for i in held_ids], np.array([score[i] for i in held_ids])) > 0.97
        assert {r.held_out for r in out if r.doc_id in held_ids} == {True}


@pytest.mark.parametrize("share", [0.2, 0.5, 0.85])
def test_estimated_prior(share):
    rng = np.random.default_rng(2)

    def sample(good):
        n = len(good)
        feature = np.where(rng.random((n, 5)) < np.where(good, 0.7, 0.2)[:, None], 0, 1) + 2 * np.arange(5)
        return np.repeat(np.arange(n), 5), feature.ravel(), n

    prior = pu.estimated_prior(sample(np.ones(3000, bool)), sample(rng.random(6000) < share), 10)
    assert share - 0.05 < prior < share + 0.1


def test_nonnegative_risk():
    zp, zu = np.array([2.0, -1.0]), np.array([0.5, -3.0, 1.0])
    soft = lambda z: np.log1p(np.exp(z))
    positive, negative = pu.nonnegative_risk(zp, zu, 0.3)
    assert positive == pytest.approx(0.3 * soft(-zp).mean())
    assert negative == pytest.approx(soft(zu).mean() - 0.3 * soft(zp).mean())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    plain = ["river", "house", "green", "walk", "stone", "paper", "light", "water", "garden", "window"]
    texts = [" ".join(rng.choices([w + str(rng.randrange(40)) for w in plain], k=60)) for _ in range(300)]
    for i in range(0, 300, 6):
        texts[i] += " vilified scoundrel"
    texts[301 - 1 :] = [texts[1] + " more", texts[7] + " password = q1w2e3r4t5y6u7", None, ""]
    passage = " ".join(f"bench{k}" for k in range(20))
    texts.append(passage)
    rows = [(i, t, "en", f"s{i}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 6 == 0 and i < 300)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("0", passage)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        left[name] = {r.doc_id: r for r in docs.collect()}
        docs = spark.createDataFrame(list(left[name].values()), docs.schema)
        if name != "bpe":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    clean = {i for i in range(300) if i % 6}
    assert clean <= set(left["toxicity"])
    assert not set(range(0, 300, 6)) & set(left["toxicity"])
    assert clean | {302, 303} <= set(left["near_dedup"])
    assert 300 not in left["near_dedup"]
    assert 304 in left["near_dedup"]
    assert 304 not in left["decontamination"]
    assert set(left["bpe"]) == set(left["secrets"]) == set(left["decontamination"])
    for i, r in left["bpe"].items():
        text = (left["secrets"][i].text or "").encode()
        assert r.decoded_sha256 == hashlib.sha256(text).hexdigest()


def test_stages_judge_rows_by_their_text(spark, tmp_path):
    """Null ids, an id that two texts have, repeated rows, null texts, extra columns and an empty table."""
    import corpus_pipeline

    rng = random.Random(14)
    words = [f"w{k}" for k in range(500)]
    long = [" ".join(rng.choices(words, k=60)) for _ in range(5)]
    passage = " ".join(f"bench{k}" for k in range(20))
    secret = long[3] + " password = q1w2e3r4t5y6u7"
    rows = [(5, long[0]), (5, long[1]), (5, long[1]), (6, long[0] + " end"), (None, secret), (None, passage), (None, None), (None, None), (7, ""), (8, long[2]), (None, long[2]), (9, secret + " x")]
    docs = documents(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    spark.createDataFrame([("0", passage)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    def texts(df):
        assert df.columns == list(corpus_pipeline.COLUMNS)
        return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)

    def wanted(*these):
        return sorted(these, key=repr)

    assert texts(corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))) == wanted(*rows)
    kept = wanted((5, long[0]), (5, long[1]), (9, secret + " x"), (None, passage), (None, None), (None, None), (7, ""), (8, long[2]))
    assert texts(corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))) == kept
    assert texts(corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))) == wanted(*(r for r in rows if r[1] != passage))
    clean = [(i, t.replace("q1w2e3r4t5y6u7", "[SECRET]") if t else t) for i, t in rows]
    got = corpus_pipeline.put_out_secrets(spark, docs, str(tmp_path))
    assert texts(got) == wanted(*clean)
    assert {r.n_chars for r in got.collect()} == {len(t) if t is not None else None for _, t in clean}
    none = docs.where("1 = 0")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name


def test_run_is_its_stages(spark):
    import corpus_pipeline

    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()))


def test_a_text_of_many_secrets(spark):
    text = " ".join(f"token=abc{k:04d}xyz" for k in range(3 * secret_scan.STEP + 5)) + " é " + "f" * 24
    found = secret_scan.scan(spark.createDataFrame([(1, text, "s"), (2, "x" + text, None)], "doc_id long, text string, source string"))
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.base] for r in found.collect()}
    assert got == {1: brute_spans(text), 2: brute_spans("x" + text)}
