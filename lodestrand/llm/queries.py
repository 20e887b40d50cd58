"""The registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import new_folder
from . import boilerplate, bpe, decontamination, divergence, hard_negatives, near_duplicates, quality, repeats, secret_scan, sharding, toxicity, winnowing
from .lineage import cut

TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = bpe.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def bpe_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them."""
    return bpe.round_trip(docs, tokenizer_path()).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def text_crc(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary"))


def scored(docs: DataFrame, labels: DataFrame, operator, held_out) -> DataFrame:
    """Scores of every row by a model that learned labels only where ``held_out`` doesn't hold."""
    model = operator.train(docs, labels, ~held_out)
    scores = operator.score(docs, model)
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= operator.THRESHOLD).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), toxicity, text_crc() % 4 == 2)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), quality, text_crc() % 5 == 0)


def op2_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Words that the two rarest terms of a window may stand off their distance to count as near.
NEAR_SLOP = 3


def contaminated_share(docs: DataFrame, items: DataFrame, carry: tuple[str, ...] = (), slop: int | None = None) -> DataFrame:
    """Phrase matches with the contamination rule: some word hit, and a twentieth of the words or more."""
    found = decontamination.phrase_matches(docs, items, carry=carry, slop=slop)
    rule = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return found.withColumn("contaminated", rule)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_share(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=NEAR_SLOP)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
        F.size("near_ids").cast("long").alias("n_near"),
    )


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text against itself with its last half put by the next document's first half, and against the next document."""
    near = winnowing.with_next(table(spark, sf_dir, "documents"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    texts = near.select("doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), "next_text")
    texts = texts.withColumn("edited_sha256", F.sha2("edited", 256))
    prints = winnowing.fingerprint(texts, ["text", "edited", "next_text"])
    return prints.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.col("text_fingerprint").alias("fingerprint"),
        F.col("edited_fingerprint"),
        F.col("edited_likeness").alias("near_edited"),
        F.col("next_text_likeness").alias("near_next"),
    )


def op6_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.classes(table(spark, sf_dir, "documents"), words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def op9_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From shards by source, where a hot source makes one shard large, to eight of equal bytes. Rows of rewritten shards are read from their new files."""
    docs = table(spark, sf_dir, "documents")
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(8)).cast("int")
    law = "bytes"
    placed = cut(sharding.reshard(docs, old, law=law))
    path = new_folder(spark, "shards")
    affected = sharding.rewrite_affected(docs, placed, path)
    out = placed.where(~F.col("shard").isin(affected)).select("doc_id", "size", "text_crc32", "shard", "slot")
    if affected and placed.where(F.col("shard").isin(affected)).limit(1).count():
        text = F.coalesce("text", F.lit(""))
        files = spark.read.parquet(path).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.col("shard").cast("int").alias("shard"), "slot")
        out = out.unionByName(files)
    return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))

    def of_kind(k: int):
        # The lambda must have one parameter: Spark passes an element's index as a second one.
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{secret_scan.KINDS[k]}")

    counts = [of_kind(k) for k in range(3)]
    spans = secret_scan.joined(secret_scan.all_spans(F.col("base"), F.col("owned")))
    return found.select("doc_id", *counts, F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"), spans.alias("spans"))


def op11_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100; labels move on by one where it is divisible by 7."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.quantised(table(spark, sf_dir, "embeddings"), "vec_id", label, "embedding")
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_run_length_index": op2_run_length_index,
    "op3_decontamination": op3_decontamination,
    "op4_winnowing": op4_winnowing,
    "op5_token_counts": op5_token_counts,
    "op6_bottom_k": op6_bottom_k,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_quality": op8_quality,
    "op9_flow_resharding": op9_flow_resharding,
    "op10_secret_scan": op10_secret_scan,
    "op11_host_suffix_array": op11_host_suffix_array,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_source_divergence": op13_source_divergence,
}


def _words_sql(pattern: str, text: str = "text") -> str:
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"regexp_extract_all(translate(ifnull({text}, ''), '{capitals}', '{capitals.lower()}'), '{pattern}')"


_PHRASES_SQL = f"""
WITH dw AS (SELECT doc_id, {_words_sql("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")} AS l FROM documents),
bw AS (SELECT item_id::VARCHAR AS item_id, {_words_sql("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")} AS l FROM benchmark),
bk AS (SELECT item_id, l, least(13, len(l)) AS n, unnest(range(1, greatest(len(l) - 12, 1) + 1)) AS k FROM bw WHERE len(l) > 0),
bwin AS (SELECT DISTINCT item_id, n, array_to_string(l[k:k + n - 1], ' ') AS win FROM bk),
dk AS (SELECT doc_id, l, n, unnest(range(1, len(l) - n + 2)) AS k FROM dw, (SELECT DISTINCT n FROM bwin) WHERE len(l) >= n),
hits AS (SELECT doc_id, k, n, item_id FROM (SELECT doc_id, k, n, array_to_string(l[k:k + n - 1], ' ') AS win FROM dk) JOIN bwin USING (n, win)),
nh AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id),
dp AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS pos FROM dw),
cw AS (SELECT w, count(*) AS c FROM dp GROUP BY w),
iw AS (SELECT row_number() OVER () AS item, item_id, l FROM bw WHERE len(l) > 0),
ip AS (SELECT item, item_id, len(l) AS n, unnest(l) AS w, generate_subscripts(l, 1) AS place FROM iw),
sp AS (SELECT ip.*, c, unnest(range(greatest(1, place - 12), least(place, greatest(1, n - 12)) + 1)) AS k FROM ip LEFT JOIN cw USING (w)),
rk AS (SELECT *, row_number() OVER (PARTITION BY item, k ORDER BY c, place) AS r, min(ifnull(c, 0)) OVER (PARTITION BY item, k) AS rarest FROM sp),
pr AS (SELECT DISTINCT a.item_id, a.w AS v, a.place AS p, b.w, b.place AS q FROM rk a JOIN rk b ON a.item = b.item AND a.k = b.k AND a.r = 1 AND b.r = 2 WHERE a.rarest > 0),
ne AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM pr JOIN dp x ON x.w = pr.v JOIN dp y USING (doc_id)
 WHERE y.w = pr.w AND abs((x.pos - p) - (y.pos - q)) <= {NEAR_SLOP} GROUP BY doc_id)
SELECT doc_id, len(l) AS n_words, ifnull(n_hit, 0) AS n_hit, ifnull(n_items, 0) AS n_items, sha256(ifnull(items, '')) AS items_sha256,
 ifnull(n_hit, 0) > 0 AND 20 * ifnull(n_hit, 0) >= len(l) AS contaminated, ifnull(n_near, 0) AS n_near
FROM dw LEFT JOIN nh USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN ne USING (doc_id)"""

_CLASSES_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words_sql("[^\\x20\\x09-\\x0D]+")} AS l FROM documents),
k AS (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 2, 1) + 1)) AS k FROM w WHERE len(l) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(l[k:k + 2], ' ') AS s FROM k),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
 GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT doc_id, ifnull(any_value(n), 0) AS n_shingles, min(r) AS component_id, min(r) = doc_id AS kept FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id"""

_REPEATS_SQL = """
WITH b AS (SELECT doc_id, hex(encode(ifnull(text, ''))) AS h FROM documents),
seg AS (SELECT doc_id, k * 1000 AS base, substr(h, k * 2000 + 1, 2198) AS g FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2000 + 1)) AS k FROM b)),
win AS (SELECT doc_id, base + j AS p, md5_number(substr(g, 2 * j + 1, 200)) AS w FROM (SELECT doc_id, base, g, unnest(range(0, least(1000, len(g) // 2 - 99))) AS j FROM seg)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS r FROM win) WHERE r > 1),
runs AS (SELECT doc_id, p, sum(CASE WHEN p - before <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run
 FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM again)),
spans AS (SELECT doc_id, min(p) AS s, max(p) + 100 AS e FROM runs GROUP BY doc_id, run),
cuts AS (SELECT doc_id, s, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS f FROM spans),
parts AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(h, 2 * f + 1, 2 * (s - f)), '' ORDER BY s) AS head
 FROM cuts JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, ifnull(n_removed, 0)::BIGINT AS n_removed, ifnull(n_spans, 0) AS n_spans,
 sha256(unhex(ifnull(head, '') || substr(h, 2 * ifnull(last, 0) + 1))) AS kept_sha256
FROM b LEFT JOIN parts USING (doc_id)"""


def _secrets_sql() -> str:
    def either_case(word: str) -> str:
        return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)

    names = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = f"""({names})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    kinds = [(0, "assign", assign), (1, "access", "AKIA[A-Z0-9]+"), (2, "hex", "[0-9a-f]+")]
    # A pattern or else one character: the pieces tile the text, so their lengths add up to positions.
    tiles = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS k, '{name}' AS kind, unnest(regexp_extract_all(text, '(?s){pattern}|.')) AS x, generate_subscripts(regexp_extract_all(text, '(?s){pattern}|.'), 1) AS i"
        f" FROM t WHERE regexp_matches(text, '{pattern}')"
        for k, name, pattern in kinds
    )
    return f"""
WITH t AS (SELECT doc_id, ifnull(source, '') AS owner, ifnull(text, '') AS text FROM documents),
tiles AS ({tiles}),
placed AS (SELECT doc_id, k, kind, x, sum(len(x)) OVER (PARTITION BY doc_id, k ORDER BY i)::BIGINT AS e FROM tiles),
valued AS (SELECT doc_id, k, kind, e - len(x) AS s, e, CASE k WHEN 0 THEN regexp_extract(x, '{assign}', 2) ELSE x END AS v FROM placed),
base AS (SELECT * FROM valued WHERE len(v) >= CASE k WHEN 0 THEN 6 WHEN 1 THEN 20 ELSE 24 END),
rare AS (SELECT v FROM base JOIN t USING (doc_id) GROUP BY v HAVING count(DISTINCT owner) = 1),
owned AS (SELECT DISTINCT doc_id, 3 AS k, 'owned' AS kind, e - len(v) AS s, e FROM base SEMI JOIN rare USING (v)
 WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
 AND NOT regexp_matches(lower(v), 'example|sample|dummy|changeme|placeholder|your|test|xxxx|\\.\\.\\.')
 AND len(list_filter(range(1, len(v) - 4), lambda i: substr(lower(v), i, 6) = repeat(substr(lower(v), i, 1), 6))) = 0),
b AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
 string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS base FROM base GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans
 FROM (SELECT doc_id, k, kind, s, e FROM base UNION ALL SELECT doc_id, k, kind, s, e FROM owned) GROUP BY doc_id)
SELECT doc_id, ifnull(n_assign, 0) AS n_assign, ifnull(n_access, 0) AS n_access, ifnull(n_hex, 0) AS n_hex, sha256(ifnull(base, '')) AS base_sha256, ifnull(spans, '') AS spans
FROM t LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)"""


#: Says where the article stands on the given pages, whose markup names it; pages without such markup are tested against brute force.
_MAIN_TEXT_SQL = """
WITH a AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(ifnull(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:h1|p)>') AS parts FROM pages),
b AS (SELECT page_id, url, list_transform(parts, lambda x: regexp_replace(x, '<[^>]*>', '', 'g')) AS parts FROM a),
c AS (SELECT page_id, url, list_transform(parts, lambda x: replace(regexp_replace(replace(replace(x, '&quot;', '"'), '&middot;', '·'), '&amp;?', '&', 'g'), '&copy;', '©')) AS parts FROM b),
d AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM c)
SELECT page_id, url, text, length(text) AS n_chars FROM d"""

_NEGATIVES_SQL = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
 FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
 FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM n WHERE rank <= 10"""

_DIVERGENCE_SQL = f"""
WITH d AS (SELECT ifnull(lang, '') AS lang, ifnull(source, '') AS source, row_number() OVER () AS r, {_words_sql("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")} AS l FROM documents),
w AS (SELECT lang, source, r, unnest(l) AS t FROM d),
k AS (SELECT lang, t FROM (SELECT DISTINCT lang, r, t FROM w) GROUP BY lang, t HAVING count(*) >= {divergence.MIN_DOCS}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, t, count(*) AS n FROM w SEMI JOIN k USING (lang, t) GROUP BY lang, source, t),
gn AS (SELECT lang, source, sum(n)::BIGINT AS s FROM c GROUP BY lang, source),
ln AS (SELECT lang, sum(s)::BIGINT AS s FROM gn GROUP BY lang),
p AS (SELECT lang, source, t, ifnull(n, 0) AS n, (1 + (1000000000::HUGEINT * (ifnull(n, 0) + 1)) // (ifnull(s, 0) + v))::BIGINT AS p
 FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, t) LEFT JOIN gn USING (lang, source)),
q AS (SELECT lang, t, (1 + (1000000000::HUGEINT * (sum(n)::BIGINT + 1)) // (s + v))::BIGINT AS q FROM c JOIN ln USING (lang) JOIN v USING (lang) GROUP BY lang, t, s, v),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value FROM p a JOIN p b USING (lang, t) WHERE a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, ifnull(value, 0) AS value
 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, t AS item, ((p - q) * (p - q)) // q AS value FROM p JOIN q USING (lang, t) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP}"""


ORACLE_SQL: dict[str, str] = {
    "op2_run_length_index": _REPEATS_SQL,
    "op3_decontamination": _PHRASES_SQL,
    "op6_bottom_k": _CLASSES_SQL,
    "op10_secret_scan": _secrets_sql(),
    "op11_host_suffix_array": _MAIN_TEXT_SQL,
    "op12_hard_negatives": _NEGATIVES_SQL,
    "op13_source_divergence": _DIVERGENCE_SQL,
}
