"""From raw documents to tokens: toxic documents go, one of each group of near copies stays, contaminated documents go, secrets are put out, the rest is encoded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm import near_duplicates, queries, secret_scan, toxicity
from lodestrand.llm.lineage import cut, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
CARRIED = COLUMNS[2:]
#: Near copies share four fifths of their distinct shingles of five words.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def _trainable() -> Column:
    return queries.text_crc() % 4 != 2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below the threshold; a model that finds no positive label rejects nothing. Null and empty texts stay, repeated rows too.

    This and the following stages judge rows one by one, by their text: a null id and an id that several texts have change nothing.
    Columns other than those of documents are left out; an empty table stays empty."""
    model = toxicity.train(docs, queries.table(spark, sf_dir, "labels"), _trainable())
    scored = toxicity.score(docs, model, carry=COLUMNS[1:])
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def _text_key() -> list[Column]:
    return [F.coalesce("doc_id", F.lit(near_duplicates.LOWEST)).alias("_key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash")]


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies stays, of the least doc_id (a null id only where no row has one); rows without words stay, each of them."""
    found = near_duplicates.classes(docs, SHINGLE_WORDS, SIMILARITY_PERCENT).where("leading")
    found = found.select(F.coalesce("doc_id", F.lit(near_duplicates.LOWEST)).alias("_key"), F.col("text_hash").alias("_hash"), (F.col("n_shingles") > 0).alias("_once")).distinct()
    kept = docs.select(*COLUMNS, *_text_key()).join(found, ["_key", "_hash"])
    once = kept.where("_once").dropDuplicates(["_key", "_hash"])
    return once.unionByName(kept.where("not _once")).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which benchmark windows cover less than a twentieth of the words, or none; rows without words stay."""
    found = queries.contaminated_share(docs, queries.table(spark, sf_dir, "benchmark"), carry=CARRIED)
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def put_out_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials that one owner has, in however many documents, are replaced in the text, and n_chars follows; what several owners share stays.

    Which spans a text loses depends on the text alone, so they come to each row by the text's digest. No row goes."""
    named = docs.select(*COLUMNS, F.sha2(F.coalesce("text", F.lit("")), 256).alias("_digest"))
    spans = secret_scan.scan(named, carry=("_digest",)).where("size(owned) > 0").select("_digest", "owned")
    joined = named.join(cut(spans.dropDuplicates(["_digest"])), "_digest", "left")
    held = F.col("owned").isNotNull()
    clean = F.when(held, secret_scan.redacted(F.col("text"), F.col("owned"))).otherwise(F.col("text"))
    out = joined.withColumn("_clean", clean)
    chars = F.when(held, F.length("_clean").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))
    return out.select("doc_id", F.col("_clean").alias("text"), "lang", "source", chars.alias("n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each text that is left."""
    return queries.bpe_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", put_out_secrets),
    ("bpe", encode),
]

#: The toxicity stage is a trained model, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each other stage is written as Parquet to the checkpoint folder and read again, so none is computed twice."""
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
