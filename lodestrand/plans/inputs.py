"""Tables that the registered queries derive from the given ones, each with its SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.text import clean_text
from ..operators.candidates import build_candidates
from . import oracle as O


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes that an Arrow function gets at once. It holds its batch several times over, and a stage has several of them on each core; texts of pages are long.
BATCH_BYTES = 2 << 20


def bytes_of(size: str) -> int:
    """A size as Spark's settings spell it: a number with or without a unit."""
    number, unit = re.fullmatch(r"\s*([0-9]+)\s*([kmgtp]?)b?\s*", size.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(bound, min(BATCH_BYTES, bytes_of(spark.conf.get(bound))))
    return table(spark, sf_dir, "pages")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, urls): lists of twenty pages' urls, with a blank line and blanks around every url. More pages make more lists, not longer ones."""
    ordered = F.array_sort(F.collect_list(F.struct("page_id", "url")))
    lines = F.array_join(F.transform(ordered, lambda x: F.concat(F.lit(" "), x["url"], F.lit(" \n"))), "\n")
    return pages(spark, sf_dir).groupBy(F.floor(F.col("page_id") / 20).alias("request_id")).agg(lines.alias("urls"))


REQUEST_URLS = "SELECT page_id // 20 AS request_id, row_number() OVER (PARTITION BY page_id // 20 ORDER BY page_id) - 1 AS ordinal, trim(url) AS url FROM pages"


def odd_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, k = F.col("url"), F.col("page_id") % 9
    rest = F.regexp_replace(u, "^https?://", "")
    odd = (
        F.when(k == 0, u).when(k == 1, F.concat(F.lit("  "), u, F.lit(" "))).when(k == 2, F.concat(F.lit("ftp://"), rest)).when(k == 3, rest)
        .when(k == 4, F.lit("http:///path")).when(k == 5, F.lit("   ")).when(k == 6, F.concat(u, F.repeat(F.lit("x"), F.lit(2100)))).when(k == 7, F.upper(u)).otherwise(F.concat(F.lit("http://me@[2001:DB8::"), F.col("page_id").cast("string"), F.lit("]:8080/x")))
    )
    return pages(spark, sf_dir).select("page_id", odd.alias("url"))


ODD_URLS = """odd AS (SELECT page_id, CASE page_id % 9 WHEN 1 THEN '  ' || url || ' ' WHEN 2 THEN 'ftp://' || regexp_replace(url, '^https?://', '') WHEN 3 THEN regexp_replace(url, '^https?://', '')
 WHEN 4 THEN 'http:///path' WHEN 5 THEN '   ' WHEN 6 THEN url || repeat('x', 2100) WHEN 7 THEN upper(url) WHEN 8 THEN 'http://me@[2001:DB8::' || page_id || ']:8080/x' ELSE url END AS url FROM pages)"""


#: Addresses by page_id: what stands before the page's number, what behind it, and whether they are not public.
ADDRESS_KINDS = (
    ("10.0.3.", "", True), ("192.168.1.", "", True), ("93.184.216.", "", False), ("127.0.0.", "", True), ("169.254.7.", "", True), ("172.20.5.", "", True), ("8.8.4.", "", False),
    ("192.0.0.1", "", True), ("::ffff:10.1.2.", "", True), ("::ffff:93.184.216.", "", True), ("0:0:0:0:0:0:0:", "", True), ("2001:db8::", "", True), ("64:ff9b:1::", "", True),
    ("FE80::", "%eth0", True), ("fd00:1:2:3::", ":9", True), ("2600:1f18::", "", False), ("2001:20::", "", False), ("2001:2::", "", True), ("2a00:1450:4001:", "::1", False), ("::", "", True),
    ("93.184.216.0", "", False), ("1::2::", "", False), ("not an address ", "", False), ("3ffe::", "", False), ("100.64.0.", "", False), ("255.1.1.", "", True), ("192.88.99.", "", False),
)


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, of = F.col("page_id"), len(ADDRESS_KINDS)
    pick = lambda k: F.element_at(F.array(*(F.lit(x[k]) for x in ADDRESS_KINDS)), (n % of + 1).cast("int"))
    some = F.concat(pick(0), (n % 50 + 11).cast("string"), pick(1))
    return pages(spark, sf_dir).select("page_id", F.array(F.concat(F.lit("93.184.1."), (n % 200).cast("string")), some).alias("addresses"))


ADDRESSES = f"addr AS (SELECT page_id, {[int(x[2]) for x in ADDRESS_KINDS]}[page_id % {len(ADDRESS_KINDS)} + 1] = 1 AS private FROM pages)"


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    pick = lambda xs, k: F.element_at(F.array(*(F.lit(x) for x in xs)), (n % k + 1).cast("int"))
    return pages(spark, sf_dir).select(
        "page_id", "url", pick((200, 200, 200, 404, 500), 5).alias("status"), pick(("text/html; charset=utf-8", "", "application/pdf", "application/xhtml+xml"), 4).alias("content_type"),
        F.when(n % 11 != 3, F.col("html")).otherwise("  ").alias("html"), (n % 17 == 2).alias("timed_out"), F.encode("html", "utf-8").alias("body"),
        pick(("utf-8", "ISO-8859-1", "UTF8"), 3).alias("header_charset"),
    )


CRAWL_ERROR = """CASE WHEN page_id % 17 = 2 THEN 'fetch_timeout' WHEN page_id % 5 IN (3, 4) OR page_id % 4 = 2 OR page_id % 11 = 3 THEN 'fetch_error' END"""


def rich_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a role, hints in and without quotes, an attribute that is none, an apostrophe in quotes, descriptions and titles of each source put in behind <head> and <body>, by page_id."""
    n = F.col("page_id")
    name = F.concat(F.lit("Item "), n.cast("string"))
    block = lambda body: F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))
    title = (
        F.when(n % 4 == 1, F.concat(F.lit('<meta property="og:title" content=" Shop '), n.cast("string"), F.lit(' &amp; more caf&eacute; ">')))
        .when(n % 4 == 2, block(F.concat(F.lit('{"@graph":[{"@type":"Brand","name":"No"},{"@type":["Thing","http://schema.org/Product"],"brand":{"@type":"Brand","name":"B"},"name":"'), name, F.lit('"}]}'))))
        .when(n % 4 == 3, block(F.lit('{"@type":"Product","name":')))
        .otherwise("")
    )
    second = F.when(n % 2 == 0, F.lit("First text here, of it.")).otherwise(F.concat(F.lit("Bob's other text "), n.cast("string"), F.lit(" of the page.")))
    about = F.concat(F.lit('<meta data-x="1>0" property="og:description" content="First  text here, of it."><meta name="description" content="'), second, F.lit('">'))
    head = F.concat(F.lit("<head>"), title, about)
    body = F.lit('<body><div role="banner"><div><p>Role text stands here.</p></div></div><div class="x ad-box"><div>Hint text.</div></div><div class=sidebar>Bare hint.</div><div data-id="header"><p>No hint at all.</p></div><div data-x="a>b <i>" title=\'c > d\'><p title=don\'t>Signs of the quotes.</p></div><p>Of 5 < 6 and << the rest of it.</p>')
    html = F.regexp_replace(F.regexp_replace("html", "<head>", ""), "(?i)<body[^>]*>", "")
    return pages(spark, sf_dir).select("page_id", "url", F.concat(F.lit("<html>"), head, F.lit("</head>"), body, html).alias("html"))


RICH = """rich AS (SELECT page_id, url, '<html><head>' || CASE page_id % 4 WHEN 1 THEN '<meta property="og:title" content=" Shop ' || page_id || ' &amp; more caf&eacute; ">'
 WHEN 2 THEN '<script type="application/ld+json">{"@graph":[{"@type":"Brand","name":"No"},{"@type":["Thing","http://schema.org/Product"],"brand":{"@type":"Brand","name":"B"},"name":"Item ' || page_id || '"}]}</script>'
 WHEN 3 THEN '<script type="application/ld+json">{"@type":"Product","name":</script>' ELSE '' END
 || '<meta data-x="1>0" property="og:description" content="First  text here, of it."><meta name="description" content="' || CASE WHEN page_id % 2 = 0 THEN 'First text here, of it.' ELSE 'Bob''s other text ' || page_id || ' of the page.' END || '"></head>'
 || '<body><div role="banner"><div><p>Role text stands here.</p></div></div><div class="x ad-box"><div>Hint text.</div></div><div class=sidebar>Bare hint.</div><div data-id="header"><p>No hint at all.</p></div><div data-x="a>b <i>" title=''c > d''><p title=don''t>Signs of the quotes.</p></div><p>Of 5 < 6 and << the rest of it.</p>'
 || regexp_replace(regexp_replace(html, '<head>', '', 'g'), '(?i)<body[^>]*>', '', 'g') AS html FROM pages)"""
RICH_TOKENS = f"{RICH}, {O.TOKENS.replace('FROM pages', 'FROM rich')}"


def full_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.block_text(H.without(H.html_tokens(pages(spark, sf_dir)), H.by_tag, H.by_role, H.by_hint))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates_of(full_texts(spark, sf_dir))


def candidates_of(texts: DataFrame) -> DataFrame:
    return build_candidates(texts.withColumnRenamed("text", "body"))


def proposals(found: DataFrame) -> DataFrame:
    """(page_id, slot, text): for each slot a candidate of the page, as it is, spelled otherwise, in part, with more behind it, something else, or with letters in each other's place."""
    n = found.groupBy("page_id").agg(F.count("*").alias("n"))
    slots = F.explode(F.array(*(F.struct(F.lit(s).alias("slot"), F.lit(k).alias("k")) for k, s in enumerate(("title", "line2", "line3"))))).alias("s")
    wanted = n.select("page_id", "n", slots).select("page_id", F.col("s.slot").alias("slot"), ((F.col("page_id") + F.col("s.k")) % F.col("n")).alias("pos"), ((F.col("page_id") + F.col("s.k")) % 6).alias("kind"))
    t = F.col("text")
    text = (
        F.when(F.col("kind") == 0, t).when(F.col("kind") == 1, F.concat(F.lit("  "), F.regexp_replace(F.upper(F.replace(t, F.lit("ß"), F.lit("ss"))), " ", "  "))).when(F.col("kind") == 2, F.substring(t, 3, 9))
        .when(F.col("kind") == 3, F.concat(t, F.lit(" and more words"))).when(F.col("kind") == 5, F.translate(t, "ei", "ie")).otherwise("zzz qqq nothing of the kind 123")
    )
    return wanted.join(found, ["page_id", "pos"]).select("page_id", "slot", text.alias("text"))


PROPOSALS = f"""pcount AS (SELECT page_id, count(*) AS n FROM candidates GROUP BY page_id),
pslots AS (SELECT page_id, slot, (page_id + k) % n AS pos, (page_id + k) % 6 AS kind FROM pcount, (VALUES ('title', 0), ('line2', 1), ('line3', 2)) s(slot, k)),
proposals AS (SELECT page_id, slot, CASE kind WHEN 0 THEN text WHEN 1 THEN '  ' || replace(upper(replace(text, 'ß', 'ss')), ' ', '  ') WHEN 2 THEN text[3:11] WHEN 3 THEN text || ' and more words' WHEN 5 THEN translate(text, 'ei', 'ie') ELSE 'zzz qqq nothing of the kind 123' END AS text FROM pslots JOIN candidates USING (page_id, pos)),
queries AS (SELECT page_id, slot, text AS proposal, {O.key("text")} AS query FROM proposals)"""
SOURCES = f"sources AS (SELECT page_id, {O.cleaned('text')} AS source_text FROM fulltext)"


def sources_of(texts: DataFrame) -> DataFrame:
    return texts.select("page_id", clean_text(F.col("text")).alias("source_text"))


def feedback_log(spark: SparkSession, sf_dir: str, deletes: bool = False) -> DataFrame:
    """(id, owner, key, title, line2, line3, ts, op) from events: a type is an owner, a user a key."""
    return log_of(table(spark, sf_dir, "events"), deletes)


def log_of(e: DataFrame, deletes: bool = False) -> DataFrame:
    op = F.when(F.lit(deletes) & (F.col("event_id") % 17 == 0), "delete").otherwise("add")
    key = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return e.select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), F.col("event_type").alias("owner"), key.alias("key"), key.alias("title"), F.lit("a").alias("line2"), F.lit("").alias("line3"), "ts", op.alias("op"))


LOG = "log AS (SELECT lpad(event_id::VARCHAR, 12, '0') AS id, event_type AS owner, 'u' || user_id AS key, ts, 'add' AS op FROM events)"


def ring_sql(op: str, source: str) -> str:
    """CTEs of ``ring``: each owner's ring after every event in turn, from the events of ``source``, where ``op`` gives add, delete or toggle."""
    drop = "list_filter(kept, lambda x: x.key <> e.key)"
    add = f"list_append({drop}, {{'key': e.key, 'id': e.id}})[-10:]"
    return f"""numbered AS (SELECT owner, key, id, {op} AS op, row_number() OVER (PARTITION BY owner ORDER BY ts, id) AS n FROM {source}),
folded AS (SELECT owner, 0::BIGINT AS n, []::STRUCT(key VARCHAR, id VARCHAR)[] AS kept FROM numbered WHERE n = 1
 UNION ALL SELECT f.owner, e.n, CASE WHEN op = 'delete' OR op = 'toggle' AND len({drop}) < len(kept) THEN {drop} ELSE {add} END FROM folded f JOIN numbered e ON e.owner = f.owner AND e.n = f.n + 1),
final AS (SELECT owner, list_reverse(arg_max(kept, n)) AS kept FROM folded GROUP BY owner),
ring AS (SELECT owner, unnest(kept).key AS key, unnest(kept).id AS id, generate_subscripts(kept, 1)::INTEGER AS recency FROM final)"""


DELETES = "CASE WHEN id::BIGINT % 17 = 0 THEN 'delete' ELSE 'add' END"
