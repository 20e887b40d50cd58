"""Every registered query over the given tables, with the SQL that it is compared with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as X
from ..operators import candidates as C
from ..operators import containment as T
from ..operators import feedback as B
from ..operators import interchange as I
from ..operators import results as R
from ..operators import verify as V
from ..lineage import kept, new_folder
from ..profiles import LATIN
from ..sources import crawl as S
from ..sources import state as A
from . import inputs as N
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


CHAIN = O.candidate_chain()
WITH_P = f"{CHAIN}, {N.PROPOSALS}, {N.SOURCES}"
doc = lambda s, d: N.table(s, d, "documents")


# Sources

@query("page_scan", "SELECT page_id, url, length(html) AS n_chars FROM pages")
def page_scan(s, d):
    return S.page_scan(s, f"{d}/pages.parquet").select("page_id", "url", F.length("html").cast("long").alias("n_chars"))


@query("url_list_explode", N.REQUEST_URLS)
def url_list_explode(s, d):
    return S.url_list_explode(N.requests(s, d)).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("request_cap", f"SELECT request_id, count(*) AS n_urls, CASE WHEN count(*) > 20 THEN 'too_many_urls' END AS error FROM ({N.REQUEST_URLS}) GROUP BY request_id")
def request_cap(s, d):
    return S.request_cap(S.url_list_explode(N.requests(s, d)))


@query("url_validate", f"WITH {N.ODD_URLS} SELECT page_id, {O.url_problem('trim(url)')} AS problem FROM odd")
def url_validate(s, d):
    return N.odd_urls(s, d).select("page_id", S.url_problem(F.col("url")).alias("problem"))


@query("url_host", f"WITH {N.ODD_URLS} SELECT page_id, CASE WHEN {O.host('trim(url)')} = '' THEN url ELSE lower({O.host('trim(url)')}) END AS host FROM odd")
def url_host(s, d):
    return N.odd_urls(s, d).select("page_id", S.url_host(F.col("url")).alias("host"))


@query("private_address_flag", f"WITH {N.ADDRESSES} SELECT page_id, private FROM addr")
def private_address_flag(s, d):
    return N.addresses(s, d).select("page_id", S.private_address_flag(F.col("addresses")).alias("private"))


@query("crawl_admit", f"SELECT page_id, {N.CRAWL_ERROR} AS error_code FROM pages")
def crawl_admit(s, d):
    return N.crawl(s, d).select("page_id", S.crawl_error(F.col("status"), F.col("content_type"), F.col("html"), F.col("timed_out")).alias("error_code"))


@query("body_truncate", "SELECT page_id, least(strlen(html), 2000) AS n_bytes, strlen(html) > 2000 AS truncated FROM pages")
def body_truncate(s, d):
    cut = N.crawl(s, d).select("page_id", S.body_truncate(F.col("body"), 2000).alias("c"))
    return cut.select("page_id", F.octet_length("c.body").cast("long").alias("n_bytes"), F.col("c.truncated").alias("truncated"))


_DECLARED = "CASE WHEN page_id % 3 = 1 THEN nullif(lower(regexp_extract(html[1:4096], '(?i)<meta[^>]+charset\\s*=\\s*[\"'']?\\s*([a-zA-Z0-9_:.-]+)', 1)), '') ELSE 'utf-8' END"


@query("charset_decode", f"SELECT page_id, replace({_DECLARED}, 'utf8', 'utf-8') AS declared, 'utf-8' AS used, md5(html) AS html_md5 FROM pages")
def charset_decode(s, d):
    return S.charset_decode(N.crawl(s, d).select("page_id", "body", "header_charset")).select("page_id", "declared", "used", F.md5("html").alias("html_md5"))


@query("charset_mix", f"SELECT coalesce({_DECLARED}, 'none') AS declared, 'utf-8' AS used, count(*) AS n_pages FROM pages GROUP BY ALL")
def charset_mix(s, d):
    return S.charset_mix(S.charset_decode(N.crawl(s, d).select("page_id", "body", "header_charset")))


@query("feedback_load", """SELECT conv_id * 1000 + turn AS line_no, CASE WHEN turn % 4 <> 2 THEN 'c' || conv_id END AS title, CASE turn % 4 WHEN 0 THEN role WHEN 1 THEN 'p0' WHEN 3 THEN '' END AS line2,
 CASE turn % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'p1' WHEN 3 THEN '' END AS line3, turn % 4 = 2 AS quarantined FROM conversations""")
def feedback_load(s, d):
    c, k = N.table(s, d, "conversations"), F.col("turn") % 4
    head = F.concat(F.lit('{"title":"c'), F.col("conv_id").cast("string"), F.lit('"'))
    line = F.when(k == 0, F.concat(head, F.lit(',"line2":"'), F.col("role"), F.lit('","line3":"x"}'))).when(k == 1, F.concat(head, F.lit(',"catchphrase_parts":["p0","p1"]}'))).when(k == 2, head).otherwise(F.concat(head, F.lit("}")))
    return S.feedback_load(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), line.alias("line")))


# HTML

@query("html_tokens", f"WITH {N.RICH_TOKENS} SELECT page_id, pos, kind, tag, token FROM tokens")
def html_tokens(s, d):
    return H.html_tokens(N.rich_pages(s, d)).withColumn("pos", F.col("pos").cast("long"))


def _kept(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("page_id").agg(F.count("*").alias("n_tokens"), F.sum("pos").alias("pos_sum"))


def _kept_sql(rule: str) -> str:
    return f"WITH {N.RICH_TOKENS}, {O.depth_steps('tokens', rule, 'nz')} SELECT page_id, count(*) AS n_tokens, sum(pos)::BIGINT AS pos_sum FROM nz WHERE depth = 0 GROUP BY page_id"


for _name, _rule, _sql in (("strip_noise_tags", H.by_tag, O.BY_TAG), ("strip_noise_roles", H.by_role, O.BY_ROLE), ("strip_noise_hints", H.by_hint, O.BY_HINT)):
    query(_name, _kept_sql(_sql))(lambda s, d, r=_rule: _kept(H.without(H.html_tokens(N.rich_pages(s, d)), r)))


@query("block_text", f"WITH {O.FULL} SELECT page_id, text FROM fulltext")
def block_text(s, d):
    return N.full_texts(s, d)


def _titled(x: str) -> str:
    return f"trim({O.replaced(O.unescaped(O.replaced(x, '<[^>]*>', ' ')), '\\s+', ' ')})"


_HTML0 = O.replaced("html", O.RAW, " ")
_TITLE = f"""titles AS (SELECT page_id, CASE WHEN page_id % 4 = 2 THEN 'Item ' || page_id WHEN len({O.meta('property', 'og:title')}) > 0 THEN {O.meta('property', 'og:title')}[1] WHEN t <> '' THEN t ELSE h END AS title,
 CASE WHEN page_id % 4 = 2 THEN 'json-ld' WHEN len({O.meta('property', 'og:title')}) > 0 THEN 'og:title' WHEN t <> '' THEN 'title' WHEN h <> '' THEN 'h1' ELSE '' END AS title_source
 FROM (SELECT *, {_titled(f"regexp_extract({_HTML0}, '(?is)<title\\b[^>]*>(.*?)</title>', 1)")} AS t, {_titled(f"regexp_extract({_HTML0}, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1)")} AS h FROM rich))"""


@query("page_title", f"WITH {N.RICH}, {_TITLE} SELECT * FROM titles")
def page_title(s, d):
    t = N.rich_pages(s, d).select("page_id", H.page_title(F.col("html")).alias("t"))
    return t.select("page_id", F.col("t.title").alias("title"), F.col("t.source").alias("title_source"))


@query("jsonld_product_name", "SELECT page_id, CASE WHEN page_id % 4 = 2 THEN 'Item ' || page_id END AS product FROM pages")
def jsonld_product_name(s, d):
    return N.rich_pages(s, d).select("page_id", H.jsonld_product_name(F.col("html")).alias("product"))


@query("meta_descriptions", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'First text here, of it.' ELSE 'First text here, of it.|Bob''s other text ' || page_id || ' of the page.' END AS descriptions FROM pages")
def meta_descriptions(s, d):
    return N.rich_pages(s, d).select("page_id", F.array_join(H.meta_descriptions(F.col("html")), "|").alias("descriptions"))


_BODIES = f"""WITH RECURSIVE {O.KEPT}, {O.depth_steps('kepttok', "tag IN ('article', 'main')", 'inmain')}, maintok AS (SELECT * FROM inmain WHERE depth > 0), {O.piece_step('maintok', 'mainpieces')}, {O.piece_step('kepttok', 'allpieces')},
{O.depth_steps('kepttok', "tag = 'a'", 'inlink')},
blocks AS (SELECT p.page_id, p.pos, p.piece, l.depth > 0 AS in_link, sum(CASE WHEN p.piece = chr(10) THEN 1 ELSE 0 END) OVER (PARTITION BY p.page_id ORDER BY p.pos) AS block FROM allpieces p JOIN inlink l ON l.page_id = p.page_id AND l.pos = p.pos),
goodblocks AS (SELECT page_id, block FROM blocks GROUP BY ALL HAVING sum(length(trim(piece))) >= 25 AND 2 * sum(CASE WHEN in_link THEN length(trim(piece)) ELSE 0 END) <= sum(length(trim(piece)))),
bodies AS (
 SELECT page_id, 'container' AS extractor, 0 AS prio, string_agg(piece, ' ' ORDER BY pos) AS text FROM mainpieces GROUP BY page_id
 UNION ALL SELECT page_id, 'density', 1, string_agg(piece, ' ' ORDER BY pos) FROM blocks SEMI JOIN goodblocks USING (page_id, block) GROUP BY page_id
 UNION ALL SELECT page_id, 'full', 2, string_agg(piece, ' ' ORDER BY pos) FROM allpieces GROUP BY page_id),
trimmedbodies AS (SELECT page_id, extractor, prio, {O.trimmed('text')} AS text, page_id || ':' || prio AS of FROM bodies WHERE {O.trimmed('text')} <> ''),
src AS (SELECT of, 0 AS source_no, text AS raw FROM trimmedbodies), {O.sentence_steps('src', 'of')},
rated AS (SELECT b.*, ifnull(n, 0) AS n FROM trimmedbodies b LEFT JOIN (SELECT of, count(*) AS n FROM candidates GROUP BY of) USING (of)),
chosen AS (SELECT page_id, extractor, n AS n_candidates, text AS body FROM rated QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n >= 3 DESC, CASE WHEN n >= 3 THEN prio END, n DESC, length(text) DESC, prio) = 1)"""


@query("body_extract", f"{_BODIES} SELECT page_id, extractor, n_candidates, md5(body) AS body_md5 FROM chosen")
def body_extract(s, d):
    return C.body_extract(N.pages(s, d), keep=kept).select("page_id", "extractor", "n_candidates", F.md5("body").alias("body_md5"))


@query("parse_page", f"{_BODIES.replace('FROM pages', 'FROM rich').replace('WITH RECURSIVE', f'WITH RECURSIVE {N.RICH}, ', 1)}, {_TITLE} SELECT page_id, title, title_source, ifnull(extractor, 'none') AS extractor, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 2 END AS n_descriptions FROM titles LEFT JOIN chosen USING (page_id)")
def parse_page(s, d):
    return C.parse_page(N.rich_pages(s, d), keep=kept).select("page_id", "title", "title_source", "extractor", F.size("descriptions").cast("long").alias("n_descriptions"))


# Text

def _doc_text(name: str, column, sql: str, alias: str) -> None:
    query(name, f"SELECT doc_id, {sql} AS {alias} FROM documents")(lambda s, d: doc(s, d).select("doc_id", column(F.col("text")).alias(alias)))


_doc_text("strip_html", lambda c: X.strip_html(F.concat(F.lit("<b>"), c, F.lit("</b> &lt;i&gt; &amp;amp; &copy;"))), O.stripped("'<b>' || text || '</b> &lt;i&gt; &amp;amp; &copy;'"), "bare")
_doc_text("normalize_ws", lambda c: X.normalize_ws(F.concat(F.lit(" \t"), F.replace(c, F.lit("\n"), F.lit("\r\n \n\n\n\t")))), O.normalized("' \t' || replace(text, chr(10), chr(13) || chr(10) || ' ' || chr(10) || chr(10) || chr(10) || chr(9))"), "clean")
_doc_text("clean_text", X.clean_text, O.cleaned("text"), "clean")
_doc_text("is_promotional", lambda c: X.is_promotional(c, LATIN), O.promotional("text"), "promotional")
_doc_text("is_noise", lambda c: X.is_noise(c, LATIN), O.noise("text"), "noise")
_doc_text("match_key", lambda c: F.md5(X.match_key(c)), f"md5({O.key('text')})", "key_md5")
_doc_text("script_ratio", lambda c: F.round(X.script_ratio(c, LATIN), 6), f"round(CASE WHEN length({O.bare('text')}) = 0 THEN 0 ELSE {O.script(O.bare('text'))} / length({O.bare('text')}) END, 6)", "ratio")
_AFFIXED = "CASE doc_id % 6 WHEN 0 THEN '[SALE today] (new) ' || text WHEN 1 THEN text || ' (50% off) [free]' WHEN 2 THEN '(plain) ' || text WHEN 3 THEN '*** (deal) ' || text || ' +++' WHEN 4 THEN repeat('[free] ', doc_id % 40) || text ELSE text END"


@query("strip_promo_affixes", f"WITH RECURSIVE a AS (SELECT doc_id, {O.trimmed('x')} AS s, 0 AS round FROM (SELECT doc_id, {_AFFIXED} AS x FROM documents) UNION ALL SELECT doc_id, n, round + 1 FROM (SELECT *, {O.affix_step('s')} AS n FROM a) WHERE n <> s) SELECT doc_id, arg_max(s, round) AS bare FROM a GROUP BY doc_id")
def strip_promo_affixes(s, d):
    k, t = F.col("doc_id") % 6, F.col("text")
    x = (
        F.when(k == 0, F.concat(F.lit("[SALE today] (new) "), t)).when(k == 1, F.concat(t, F.lit(" (50% off) [free]"))).when(k == 2, F.concat(F.lit("(plain) "), t))
        .when(k == 3, F.concat(F.lit("*** (deal) "), t, F.lit(" +++"))).when(k == 4, F.concat(F.repeat(F.lit("[free] "), (F.col("doc_id") % 40).cast("int")), t)).otherwise(t)
    )
    return doc(s, d).select("doc_id", X.strip_promo_affixes(x, LATIN).alias("bare"))


_DOC_STEPS = f"WITH RECURSIVE src AS (SELECT doc_id, 0 AS source_no, text AS raw FROM documents), {O.sentence_steps('src', 'doc_id')}"


@query("split_sentences", f"{_DOC_STEPS} SELECT doc_id, sent_no, sentence FROM sents")
def split_sentences(s, d):
    return doc(s, d).select("doc_id", F.posexplode(X.split_sentences(X.clean_text(F.col("text")), LATIN)).alias("sent_no", "sentence")).withColumn("sent_no", F.col("sent_no").cast("long"))


@query("split_long", f"{_DOC_STEPS} SELECT doc_id, sent_no, piece_no, text FROM pieces")
def split_long(s, d):
    sents = doc(s, d).select("doc_id", F.posexplode(X.split_sentences(X.clean_text(F.col("text")), LATIN)).alias("sent_no", "sentence"))
    bare = sents.withColumn("bare", X.strip_promo_affixes(F.col("sentence"), LATIN))
    out = bare.select("doc_id", F.col("sent_no").cast("long").alias("sent_no"), F.posexplode(X.split_long(F.col("bare"), LATIN)).alias("piece_no", "text")).where("text <> ''")
    return out.withColumn("piece_no", F.col("piece_no").cast("long"))


@query("dedupe_sentences", f"{_DOC_STEPS} SELECT doc_id, sent_no, sentence FROM sents WHERE {O.key('sentence')} <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, {O.key('sentence')} ORDER BY sent_no) = 1")
def dedupe_sentences(s, d):
    return C.dedupe_sentences(split_sentences(s, d), "doc_id", "sentence", "sent_no").drop("match_key")


# Candidates

def found(s, d):
    return N.candidates(s, d).withColumn("pos", F.col("pos").cast("long"))


_SAID = f"""{_BODIES.replace('FROM pages', 'FROM rich').replace('WITH RECURSIVE', f'WITH RECURSIVE {N.RICH}, ', 1)},
said AS (SELECT page_id, list_distinct(list_concat({O.meta('property', 'og:description')}, {O.meta('name', 'description')})) AS l, {O.meta('property', 'og:description')} AS og FROM rich),
src2 AS (SELECT page_id, generate_subscripts(l, 1) AS source_no, unnest(list_concat(og, list_filter(l, lambda x: NOT list_contains(og, x)))) AS raw FROM said UNION ALL SELECT page_id, 1000, body FROM chosen), {O.renamed_steps('src2', 'page_id')}"""


@query("build_candidates", f"{_SAID} SELECT page_id, pos, text, match_key FROM candidates2")
def build_candidates(s, d):
    """Of descriptions first, then of the body that the extractors' gate chose."""
    return C.parsed_candidates(N.rich_pages(s, d), keep=kept)[1].withColumn("pos", F.col("pos").cast("long"))


@query("body_candidates", f"{CHAIN} SELECT page_id, pos, text, match_key FROM candidates")
def body_candidates(s, d):
    """Of all text of a page."""
    return found(s, d)


@query("candidates_or_error", f"{_SAID} SELECT page_id, count(pos) AS n_candidates, CASE WHEN count(pos) = 0 THEN 'content_extraction_error' END AS error_code FROM pages LEFT JOIN candidates2 USING (page_id) GROUP BY page_id")
def candidates_or_error(s, d):
    return C.candidates_or_error(N.pages(s, d), build_candidates(s, d))


@query("source_text", f"WITH {O.FULL}, dsc AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'First text here, of it.' ELSE 'First text here, of it.' || chr(10) || 'Bob''s other text ' || page_id || ' of the page.' END AS x FROM pages) SELECT page_id, x || chr(10) || {O.cleaned('text')} AS source_text FROM fulltext JOIN dsc USING (page_id)")
def source_text(s, d):
    about = N.rich_pages(s, d).select("page_id", H.meta_descriptions(F.col("html")).alias("descriptions"))
    return C.source_text(about.join(N.full_texts(s, d).withColumnRenamed("text", "body"), "page_id"))


@query("pack_candidates", f"{CHAIN}, ln AS (SELECT page_id, pos, (pos + 1) || '. ' || text AS line FROM candidates), tot AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY page_id ORDER BY pos) AS total FROM ln) SELECT page_id, string_agg(line, chr(10) ORDER BY pos) AS prompt FROM tot WHERE total <= 600 GROUP BY page_id")
def pack_candidates(s, d):
    return C.pack_candidates(found(s, d), 600)


_SCORED = f"{CHAIN}, scored AS (SELECT *, {O.score('text', 'pos')} AS score FROM candidates), ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS rank FROM scored)"


@query("score_sentence", f"{_SCORED} SELECT page_id, pos, score FROM scored")
def score_sentence(s, d):
    return found(s, d).select("page_id", "pos", X.score_sentence(F.col("text"), F.col("pos"), LATIN).alias("score"))


@query("rank_candidates", f"{_SCORED} SELECT page_id, pos, rank FROM ranked")
def rank_candidates(s, d):
    return C.rank_candidates(found(s, d)).select("page_id", "pos", F.col("rank").cast("long").alias("rank"))


@query("top_candidates", f"{_SCORED} SELECT page_id, pos, rank, text FROM ranked WHERE rank <= 5")
def top_candidates(s, d):
    return C.rank_candidates(found(s, d), LATIN, 5).select("page_id", "pos", F.col("rank").cast("long").alias("rank"), "text")


_BEST = f"{_SCORED} SELECT page_id, text FROM ranked WHERE pos <> page_id % 3 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) = 1"


@query("pick_best", _BEST)
def pick_best(s, d):
    c = found(s, d)
    return C.pick_best(c, c.where("pos = page_id % 3").select("page_id", "match_key")).select("page_id", "text")


# Verification

def parsed(s, d):
    """(candidates, sources with keys) of the pages' texts, which are read and cut once."""
    texts = kept(N.full_texts(s, d))
    return kept(N.candidates_of(texts)), kept(V.with_keys(N.sources_of(texts)))


def verified(s, d):
    c, t = parsed(s, d)
    return kept(V.keyed(N.proposals(c))), c, t


_EXACT = "exact AS (SELECT q.page_id, slot, arg_min(text, pos) AS text FROM queries q JOIN candidates c ON q.page_id = c.page_id AND query = match_key GROUP BY ALL)"
_SLICE = f"""hits AS (SELECT q.page_id, slot, query, source_text, instr({O.key('source_text')}, query) AS hit FROM queries q JOIN sources s USING (page_id) WHERE query <> '' AND contains({O.key('source_text')}, query)),
place AS (SELECT page_id, slot, hit, length(query) AS n, source_text, list_filter(range(1, length(source_text) + 1), lambda i: trim(source_text[i], ' ' || chr(10) || chr(9)) <> '') AS solid FROM hits),
slice AS (SELECT page_id, slot, {O.trimmed('source_text[solid[hit]:solid[hit + n - 1]]')} AS text FROM place)"""
_HOLDS = "holds AS (SELECT q.page_id, slot, arg_max(text, length(match_key) * 1000 - pos) AS text FROM queries q JOIN candidates c ON q.page_id = c.page_id AND contains(query, match_key) WHERE query <> '' GROUP BY ALL)"
_STRICT = f"""{WITH_P}, {_EXACT}, {_SLICE}, {_HOLDS}, strict AS (SELECT q.page_id, q.slot, query, coalesce(e.text, s.text, h.text, '') AS text, CASE WHEN e.text IS NOT NULL THEN 'exact' WHEN coalesce(s.text, h.text) IS NOT NULL THEN 'contained' ELSE 'none' END AS method
 FROM queries q LEFT JOIN exact e USING (page_id, slot) LEFT JOIN slice s USING (page_id, slot) LEFT JOIN holds h USING (page_id, slot))"""
_RESOLVED_EXACT = f"{_STRICT}, resolved AS (SELECT page_id, slot, text, method FROM strict)"
_RESOLVED = f"""{_STRICT}, open AS (SELECT page_id, slot, query FROM strict WHERE method = 'none'), {O.alike("fuzzy", "open", "candidates", LATIN.min_ratio)},
resolved AS (SELECT s.page_id, s.slot, query, CASE WHEN method <> 'none' THEN s.text ELSE ifnull(f.text, '') END AS text, CASE WHEN method <> 'none' THEN method WHEN f.text IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS method FROM strict s LEFT JOIN fuzzy f USING (page_id, slot))"""


@query("match_exact", f"{WITH_P}, {_EXACT} SELECT page_id, slot, text FROM exact")
def match_exact(s, d):
    q, c, _ = verified(s, d)
    return V.match_exact(q, c).select("page_id", "slot", "text")


@query("match_contained_slice", f"{WITH_P}, {_SLICE} SELECT page_id, slot, text FROM slice")
def match_contained_slice(s, d):
    q, _, t = verified(s, d)
    return V.match_contained_slice(q, t).select("page_id", "slot", "text")


@query("contained_items", f"""WITH d AS (SELECT doc_id, text, {O.key('text')} AS k FROM documents), b AS (SELECT item_id, {O.key('text')} AS q FROM benchmark WHERE {O.key('text')} <> ''
 UNION ALL SELECT -1 - item_id, {O.key('text[1:40]')} FROM benchmark WHERE {O.key('text[1:40]')} <> ''),
hit AS (SELECT doc_id, item_id, text, instr(k, q) AS p, length(q) AS n FROM d JOIN b ON contains(k, q)),
solid AS (SELECT *, list_filter(range(1, length(text) + 1), lambda i: trim(text[i], ' ' || chr(9) || chr(10) || chr(13)) <> '') AS s FROM hit)
SELECT doc_id, item_id, p - 1 AS "at", s[p] - 1 AS start, s[p + n - 1] - s[p] + 1 AS size FROM solid""")
def contained_items(s, d):
    """Every document against every benchmark item, and against the head of each."""
    items = N.table(s, d, "benchmark")
    heads = items.select((-1 - F.col("item_id")).alias("item_id"), F.substring("text", 1, 40).alias("text"))
    found = T.contained(doc(s, d), items.select("item_id", "text").unionByName(heads))
    return found.select("doc_id", "item_id", *(F.col(c).cast("long").alias(c) for c in ("at", "start", "size")))


@query("match_contained_candidate", f"{WITH_P}, {_HOLDS} SELECT page_id, slot, text FROM holds")
def match_contained_candidate(s, d):
    q, c, _ = verified(s, d)
    return V.match_contained_candidate(q, c).select("page_id", "slot", "text")


@query("fuzzy_prune", f"{WITH_P} SELECT q.page_id, slot, pos FROM queries q JOIN candidates c ON q.page_id = c.page_id WHERE length(query) >= 6 AND 2.0 * least(length(query), length(match_key)) / (length(query) + length(match_key)) >= 0.75")
def fuzzy_prune(s, d):
    q, c, _ = verified(s, d)
    return V.fuzzy_prune(q, c, 0.75).select(q.page_id, "slot", "pos")


@query("match_fuzzy", f"{WITH_P}, {O.alike('fuzzy', 'queries', 'candidates', LATIN.min_ratio)} SELECT page_id, slot, text, 'fuzzy' AS method, ratio FROM fuzzy")
def match_fuzzy(s, d):
    q, c, _ = verified(s, d)
    return V.most_alike(q, c, LATIN.min_ratio, "fuzzy")


@query("match_nearest", f"{WITH_P}, others AS (SELECT * FROM candidates WHERE pos <> page_id % 3), {O.alike('nearest', 'queries', 'others', LATIN.fallback_ratio)} SELECT page_id, slot, text, 'nearest' AS method, ratio FROM nearest")
def match_nearest(s, d):
    q, c, _ = verified(s, d)
    return V.most_alike(q, c.where("pos <> page_id % 3"), LATIN.fallback_ratio, "nearest")


# Each of the following is the whole cascade; the queries named _exact leave the fuzzy and nearest steps out.

def resolve(s, d, fuzzy: bool = True):
    q, c, t = verified(s, d)
    return V.resolve(q, c, t, fuzzy=fuzzy)


_BEST_SCORED = f"scored AS (SELECT *, {O.score('text', 'pos')} AS score FROM candidates), best AS (SELECT page_id, text AS best FROM scored QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) = 1)"
_FIRST_EXACT = f""", {_BEST_SCORED}, second AS (SELECT page_id, CASE WHEN method <> 'none' THEN text ELSE best END AS line2, CASE WHEN method <> 'none' THEN method ELSE 'unverified' END AS method2
 FROM resolved LEFT JOIN best USING (page_id) WHERE slot = 'line2')"""
_FIRST = f""", {_BEST_SCORED}, open2 AS (SELECT page_id, slot, query FROM resolved WHERE slot = 'line2' AND method = 'none'), {O.alike("near2", "open2", "candidates", LATIN.fallback_ratio)},
second AS (SELECT r.page_id, CASE WHEN method <> 'none' THEN r.text ELSE coalesce(n.text, best) END AS line2, CASE WHEN method <> 'none' THEN method WHEN n.text IS NOT NULL THEN 'nearest' ELSE 'unverified' END AS method2
 FROM resolved r LEFT JOIN best USING (page_id) LEFT JOIN near2 n USING (page_id, slot) WHERE slot = 'line2')"""
_THIRD = f"r.method <> 'none' AND {O.key('r.text')} <> {O.key('s.line2')}"
_ALLOWED = f"allowed AS (SELECT c.* FROM scored c JOIN second s ON c.page_id = s.page_id WHERE match_key <> {O.key('line2')}), best3 AS (SELECT page_id, text AS best FROM allowed QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) = 1)"
_PAIR_EXACT = f"""{_RESOLVED_EXACT}{_FIRST_EXACT}, {_ALLOWED}, third AS (SELECT r.page_id, CASE WHEN {_THIRD} THEN r.text ELSE ifnull(b.best, '') END AS line3, CASE WHEN {_THIRD} THEN r.method WHEN b.best IS NOT NULL THEN 'unverified' ELSE 'none' END AS method3
 FROM resolved r JOIN second s ON r.page_id = s.page_id LEFT JOIN best3 b ON b.page_id = r.page_id WHERE r.slot = 'line3')"""
_PAIR = f"""{_RESOLVED}{_FIRST}, {_ALLOWED}, open3 AS (SELECT r.page_id, r.slot, r.query FROM resolved r JOIN second s ON r.page_id = s.page_id WHERE r.slot = 'line3' AND NOT ({_THIRD})), {O.alike("near3", "open3", "allowed", LATIN.fallback_ratio)},
third AS (SELECT r.page_id, CASE WHEN {_THIRD} THEN r.text ELSE coalesce(n.text, b.best, '') END AS line3, CASE WHEN {_THIRD} THEN r.method WHEN n.text IS NOT NULL THEN 'nearest' WHEN b.best IS NOT NULL THEN 'unverified' ELSE 'none' END AS method3
 FROM resolved r JOIN second s ON r.page_id = s.page_id LEFT JOIN best3 b ON b.page_id = r.page_id LEFT JOIN near3 n ON n.page_id = r.page_id WHERE r.slot = 'line3')"""


def both_ways(name: str, sql: str, f) -> None:
    """Registers the whole cascade under ``name`` (and its earlier name ``name``_fuzzy) and the one without similarity as ``name``_exact; ``sql`` has places
    for the steps of either."""
    whole = {"resolved": _RESOLVED, "first": _RESOLVED + _FIRST, "pair": _PAIR}
    strict = {"resolved": _RESOLVED_EXACT, "first": _RESOLVED_EXACT + _FIRST_EXACT, "pair": _PAIR_EXACT}
    for suffix, steps, fuzzy in (("", whole, True), ("_fuzzy", whole, True), ("_exact", strict, False)):
        text = sql
        for k, v in steps.items():
            text = text.replace(f"<{k}>", v)
        query(name + suffix, text)(lambda s, d, fuzzy=fuzzy: f(s, d, fuzzy))


both_ways("resolve", "<resolved> SELECT page_id, slot, text, method FROM resolved", lambda s, d, fuzzy: resolve(s, d, fuzzy).select("page_id", "slot", "text", "method"))


@query("resolve_fuzzy", f"{_RESOLVED} SELECT r.page_id, r.slot, r.text, r.method, CASE r.method WHEN 'fuzzy' THEN ratio WHEN 'none' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS ratio FROM resolved r LEFT JOIN fuzzy USING (page_id, slot)")
def resolve_fuzzy(s, d):
    """``resolve`` with its ratios."""
    return resolve(s, d)


def lines(s, d, fuzzy: bool):
    q, c, t = verified(s, d)
    return V.resolve_line(q.where("slot = 'line2'"), c, t, c.select("page_id", "match_key").where("1 = 0"), fuzzy=fuzzy).select("page_id", "text", "method")


both_ways("resolve_line", "<first> SELECT page_id, line2 AS text, method2 AS method FROM second", lines)


both_ways("resolve_pair", "<pair> SELECT page_id, line2, method2, line3, method3 FROM second JOIN third USING (page_id)", lambda s, d, fuzzy: V.resolve_pair(*verified(s, d), fuzzy=fuzzy))


def titles(s, d, fuzzy: bool):
    c, t = parsed(s, d)
    own = c.select("page_id").distinct().select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("T"), F.col("page_id").cast("string"))).otherwise("").alias("title"))
    return V.resolve_title(own, N.proposals(c), c, t, fuzzy=fuzzy)


both_ways("resolve_title", "<resolved> SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'T' || page_id ELSE text END AS title FROM resolved WHERE slot = 'title'", titles)


def audit(s, d, fuzzy: bool):
    q, c, t = verified(s, d)
    found = kept(V.resolve_pair(q, c, t, fuzzy=fuzzy))
    return V.verbatim_audit(found.select("page_id", F.explode(F.array("line2", "line3")).alias("text")), t)


both_ways("verbatim_audit", f"<pair>, said AS (SELECT page_id, line2 AS text FROM second UNION ALL SELECT page_id, line3 FROM third) SELECT count(*) AS n_lines, count(*) FILTER (NOT contains({O.key('source_text')}, {O.key('text')})) AS n_violations FROM said JOIN sources USING (page_id) WHERE text <> ''", audit)


def marks(s, d, fuzzy: bool):
    q, c, t = verified(s, d)
    chosen = V.resolve_pair(q, c, t, fuzzy=fuzzy).select("page_id", F.explode(F.array("line2", "line3")).alias("text"))
    return V.mark_chosen(c.withColumn("pos", F.col("pos").cast("long")), chosen)


both_ways("mark_chosen", f"<pair> SELECT c.page_id, pos, {O.replaced('text', '\\s')} IN ({O.replaced('line2', '\\s')}, {O.replaced('line3', '\\s')}) AND text <> '' AS chosen FROM candidates c JOIN second USING (page_id) JOIN third USING (page_id)", marks)


# Interchange

def _requests(s, d):
    e, k = N.table(s, d, "events"), F.col("event_id") % 3
    return e.select(F.col("event_id").alias("request_id"), F.col("event_type").alias("owner"), F.when(k == 0, F.lit(None)).when(k == 1, F.lit("")).otherwise(F.concat(F.lit("as "), F.col("user_id").cast("string"))).alias("persona_prompt"))


_PERSONA_SQL = """WITH st AS (SELECT event_type AS owner, CASE WHEN event_type < 'l' THEN 'saved ' || event_type ELSE '' END AS active FROM events GROUP BY event_type)
SELECT event_id AS request_id, CASE event_id % 3 WHEN 0 THEN nullif(active, '') WHEN 2 THEN 'as ' || user_id END AS persona, CASE event_id % 3 WHEN 0 THEN active <> '' WHEN 1 THEN false ELSE true END AS persona_applied FROM events JOIN st ON owner = event_type"""


def _settings(s, d):
    return N.table(s, d, "events").select(F.col("event_type").alias("owner")).distinct().withColumn("active_prompt", F.when(F.col("owner") < "l", F.concat(F.lit("saved "), "owner")).otherwise(""))


@query("resolve_persona", _PERSONA_SQL)
def resolve_persona(s, d):
    return I.resolve_persona(_requests(s, d), _settings(s, d))


_ROUTE_SQL = "SELECT event_id AS request_id, CASE user_id % 4 WHEN 0 THEN 'small' WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN 'large' ELSE 'small' END WHEN 2 THEN 'base' ELSE 'base' END AS route FROM events"


@query("resolve_route", _ROUTE_SQL)
def resolve_route(s, d):
    k = F.col("user_id") % 4
    asked = N.table(s, d, "events").select(
        F.col("event_id").alias("request_id"), F.when(k == 0, F.lit("small")).when(k == 2, F.lit("unknown")).otherwise(F.lit("")).alias("model_id"),
        F.when(k == 1, F.when(F.col("event_id") % 2 == 0, F.lit("large")).otherwise("small")).when(k == 0, F.lit("large")).alias("saved_model_id"),
    )
    routes = s.createDataFrame([("base", 0, True), ("small", 1, False), ("large", 2, False)], "model_id string, ordinal int, is_default boolean")
    return I.resolve_route(asked, routes)


@query("system_prompt", f"""SELECT conv_id, {O.lit(I.BASE_PROMPT)} || CASE WHEN conv_id % 2 = 0 THEN chr(10) || chr(10) || 'Point of view:' || chr(10) || 'view ' || conv_id ELSE '' END
 || string_agg(chr(10) || chr(10) || 'Example ' || place || chr(10) || '1: ' || role || chr(10) || '2: t' || turn, '' ORDER BY turn) AS prompt
 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations) WHERE place <= {B.PROMPT_EXAMPLES} GROUP BY conv_id""")
def system_prompt(s, d):
    """All turns, up to the feature's own number of examples."""
    ranked = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return _prompts(N.table(s, d, "conversations").withColumn("place", ranked).where(F.col("place") <= B.PROMPT_EXAMPLES))


def _prompts(c: DataFrame) -> DataFrame:
    shown = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("title"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("line2"), F.lit("").alias("line3"))))
    persona = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("view "), F.col("conv_id").cast("string")))
    return c.groupBy("conv_id").agg(shown.alias("examples")).select("conv_id", I.system_prompt(persona, F.col("examples")).alias("prompt"))


@query("request_rows", f"{CHAIN}, ln AS (SELECT page_id, pos, (pos + 1) || '. ' || text AS line FROM candidates), tot AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY page_id ORDER BY pos) AS total FROM ln), pk AS (SELECT page_id, string_agg(line, chr(10) ORDER BY pos) AS prompt FROM tot WHERE total <= {LATIN.prompt_chars} GROUP BY page_id) SELECT page_id, 'title:' || chr(10) || CASE WHEN page_id % 2 = 0 THEN url ELSE '(不明)' END || chr(10) || chr(10) || 'candidates:' || chr(10) || prompt AS message FROM pages JOIN pk USING (page_id)")
def request_rows(s, d):
    """All candidates under the profile's budget."""
    return _messages(s, d, C.pack_candidates(found(s, d), LATIN.prompt_chars))


def _messages(s, d, packed: DataFrame) -> DataFrame:
    titles = N.pages(s, d).select("page_id", F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise("").alias("title"))
    return I.request_rows(titles, packed)


def _responses(s, d):
    p, k = N.pages(s, d), F.col("page_id") % 6
    body = F.concat(F.lit('{"title":"t {'), F.col("page_id").cast("string"), F.lit('","line2":[" a ","b"],"line3":null}'))
    raw = (
        F.when(k == 0, body).when(k == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone"))).when(k == 2, F.concat(F.lit("I chose {x} and "), body, F.lit(" {")))
        .when(k == 3, F.concat(F.lit("<think>{\"title\":\"no\"}</think>"), body)).when(k == 4, F.lit('{"title": "cut')).otherwise("  ")
    )
    return p.select("page_id", raw.alias("raw"))


_JSON = "CASE WHEN page_id % 6 < 4 THEN '{\"title\":\"t {' || page_id || '\",\"line2\":[\" a \",\"b\"],\"line3\":null}' END"


@query("parse_response", f"SELECT page_id, {_JSON} AS json, CASE WHEN page_id % 6 >= 4 THEN 'llm_parse_error' END AS error_code FROM pages")
def parse_response(s, d):
    return I.parse_response(_responses(s, d))


@query("coerce_fields", "SELECT page_id, 't {' || page_id AS title, 'a b' AS line2, '' AS line3 FROM pages WHERE page_id % 6 < 4")
def coerce_fields(s, d):
    return I.coerce_fields(I.parse_response(_responses(s, d)).where("json is not null"))


# Feedback

@query("feedback_key", f"SELECT conv_id, turn, md5({O.replaced("role || ' ' || text || ' '", '\\s')}) AS key_md5 FROM conversations")
def feedback_key(s, d):
    return N.table(s, d, "conversations").select("conv_id", "turn", F.md5(B.feedback_key(F.col("role"), F.col("text"), F.lit(""))).alias("key_md5"))


_LATEST = f"WITH {N.LOG}, latest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY owner, key ORDER BY ts DESC, id DESC) = 1), recent AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY ts DESC, id DESC) AS recency FROM latest QUALIFY recency <= 10)"
_LISTED = f"{_LATEST}, allof AS (SELECT owner, 0 AS part, recency AS n, key, false AS builtin FROM recent UNION ALL SELECT owner, 1, position, key, true FROM (SELECT DISTINCT owner FROM recent), (VALUES (1, 'fixed-1'), (2, 'fixed-2')) f(position, key)), listed AS (SELECT owner, row_number() OVER (PARTITION BY owner ORDER BY part, n) AS place, key, builtin FROM allof)"


@query("feedback_latest", f"{_LATEST} SELECT owner, key, id FROM latest")
def feedback_latest(s, d):
    return B.feedback_latest(N.feedback_log(s, d)).select("owner", "key", "id")


def recent(s, d):
    return B.feedback_recent(N.feedback_log(s, d)).select("owner", "key", "id", F.col("recency").cast("long").alias("recency"))


@query("feedback_recent", f"{_LATEST} SELECT owner, key, id, recency FROM recent")
def feedback_recent(s, d):
    return recent(s, d)


_RING = f"WITH RECURSIVE {N.LOG}, {N.ring_sql(N.DELETES, 'log')} SELECT owner, key, id, recency FROM ring"


@query("feedback_ring", _RING)
def feedback_ring(s, d):
    return B.feedback_ring(N.feedback_log(s, d, deletes=True))


def listed(s, d):
    return B.feedback_list(recent(s, d), ("fixed-1", "fixed-2")).withColumn("place", F.col("place").cast("long"))


@query("feedback_list", f"{_LISTED} SELECT * FROM listed")
def feedback_list(s, d):
    return listed(s, d)


@query("prompt_examples", f"{_LISTED} SELECT * FROM listed WHERE place <= 6")
def prompt_examples(s, d):
    return B.prompt_examples(listed(s, d))


@query("feedback_toggle", f"WITH RECURSIVE {N.LOG}, few AS (SELECT * REPLACE ('u' || (substr(key, 2)::BIGINT % 23) AS key) FROM log), own AS (SELECT * FROM few WHERE key <> 'u7'), {N.ring_sql("'toggle'", 'own')} SELECT owner, key, id, recency FROM ring")
def feedback_toggle(s, d):
    """Of 23 keys, more than a ring holds, so that many a toggle comes after its key was pushed out; one is a fixed entry."""
    few = F.concat(F.lit("u"), (F.substring("key", 2, 20).cast("long") % 23).cast("string"))
    return B.feedback_toggle(N.feedback_log(s, d).withColumn("key", few), s.createDataFrame([("u7",)], "key string"))


@query("feedback_delete", "SELECT event_id::VARCHAR AS id, CASE WHEN event_id % 10 = 0 AND event_id % 3 = 0 THEN 'protected' WHEN event_id % 3 = 0 THEN 'deleted' ELSE 'kept' END AS outcome, event_id % 3 <> 0 OR event_id % 10 = 0 AS kept FROM events UNION ALL SELECT 'x' || event_id, 'not_found', false FROM events WHERE event_id % 100 = 7")
def feedback_delete(s, d):
    e = N.table(s, d, "events")
    entries = e.select(F.col("event_id").cast("string").alias("id"), (F.col("event_id") % 10 == 0).alias("builtin"))
    asked = e.where("event_id % 3 = 0").select(F.col("event_id").cast("string").alias("id")).unionByName(e.where("event_id % 100 = 7").select(F.concat(F.lit("x"), F.col("event_id").cast("string")).alias("id")))
    return B.feedback_delete(entries, asked)


@query("feedback_exists", f"{_LATEST} SELECT event_id, 'u' || user_id IN (SELECT key FROM recent WHERE owner = 'click') AS registered FROM events")
def feedback_exists(s, d):
    results = N.table(s, d, "events").select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"))
    return B.feedback_exists(results, recent(s, d).where("owner = 'click'")).select("event_id", "registered")


def _presets(s, d):
    prompt = F.when(F.col("event_id") % 7 == 0, F.repeat(F.lit("p"), F.lit(500))).otherwise(F.concat(F.lit("p"), (F.col("event_id") % 11).cast("string")))
    return N.table(s, d, "events").select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), F.col("user_id").alias("owner"), "ts", prompt.alias("prompt"))


@query("preset_admit", """WITH p AS (SELECT lpad(event_id::VARCHAR, 12, '0') AS id, user_id AS owner, ts, event_id % 7 = 0 AS long, CASE WHEN event_id % 7 = 0 THEN 'long' ELSE 'p' || (event_id % 11) END AS prompt FROM events),
f AS (SELECT *, NOT long AND row_number() OVER (PARTITION BY owner, long, prompt ORDER BY ts, id) = 1 AS fresh FROM p)
SELECT a.id, a.owner, CASE WHEN a.long THEN 'too_long' WHEN (SELECT count(*) FROM f b WHERE b.owner = a.owner AND b.fresh AND (b.ts < a.ts OR b.ts = a.ts AND b.id < a.id)) >= 5 THEN 'cap' WHEN NOT a.fresh THEN 'duplicate' END AS reason FROM f a""")
def preset_admit(s, d):
    return B.preset_admit(_presets(s, d))


@query("preset_delete", "SELECT lpad(event_id::VARCHAR, 12, '0') AS id, CASE WHEN event_id % 5 = 1 THEN 'deleted' ELSE 'kept' END AS outcome FROM events")
def preset_delete(s, d):
    p = _presets(s, d)
    return B.feedback_delete(p.select("id", F.lit(False).alias("builtin")), p.where("cast(id as long) % 5 = 1")).select("id", "outcome")


@query("active_setting", "SELECT user_id AS owner, arg_max('p' || (event_id % 11), (ts, lpad(event_id::VARCHAR, 12, '0'))) AS value FROM events WHERE event_id % 7 <> 0 GROUP BY user_id")
def active_setting(s, d):
    return B.active_setting(_presets(s, d).withColumnRenamed("prompt", "value"))


@query("feedback_validate", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'title_required' WHEN turn % 3 = 1 THEN 'line_required' END AS problem, CASE WHEN turn % 4 = 0 THEN 'name_required' WHEN length(trim(text)) > 40 THEN 'name_too_long' END AS name_problem FROM conversations")
def feedback_validate(s, d):
    t = F.col("turn")
    title, line = F.when(t % 3 == 0, "  ").otherwise(F.col("role")), F.when(t % 3 == 1, " ").otherwise("x")
    return N.table(s, d, "conversations").select("conv_id", "turn", B.feedback_problem(title, line, F.lit(None).cast("string")).alias("problem"), B.preset_problem(F.when(t % 4 == 0, " ").otherwise(F.col("text"))).alias("name_problem"))


# Results

def outcomes_of(s, d, candidates: DataFrame) -> DataFrame:
    crawl = N.crawl(s, d).select("page_id", "url", S.crawl_error(F.col("status"), F.col("content_type"), F.col("html"), F.col("timed_out")).alias("crawl_error"))
    counts = C.candidates_or_error(N.pages(s, d), candidates).withColumnRenamed("error_code", "content_error")
    return R.error_isolation(crawl.join(counts, "page_id"), "crawl_error", "content_error")


def outcomes(s, d):
    return outcomes_of(s, d, found(s, d))


_OUTCOME = f"{CHAIN}, cnt AS (SELECT page_id, url, count(pos) AS n FROM pages LEFT JOIN candidates USING (page_id) GROUP BY ALL), outcomes AS (SELECT page_id, url, n AS n_candidates, coalesce({N.CRAWL_ERROR}, CASE WHEN n = 0 THEN 'content_extraction_error' END) AS error_code FROM cnt)"


@query("error_isolation", f"{_OUTCOME} SELECT page_id, n_candidates, error_code FROM outcomes")
def error_isolation(s, d):
    return outcomes(s, d).select("page_id", "n_candidates", "error_code")


def assembled(s, d, fuzzy: bool):
    q, c, t = verified(s, d)
    done = outcomes_of(s, d, c).join(V.resolve_pair(q, c, t, fuzzy=fuzzy).select("page_id", "line2", "line3"), "page_id", "left")
    done = done.select("url", F.concat(F.lit("T"), F.col("page_id").cast("string")).alias("title"), "line2", "line3", "error_code")
    return R.assemble_results(S.url_list_explode(N.requests(s, d)).withColumn("ordinal", F.col("ordinal").cast("long")), done)


both_ways("results", f"<pair>, cnt AS (SELECT page_id, url, count(pos) AS n FROM pages LEFT JOIN candidates USING (page_id) GROUP BY ALL), assembled AS (SELECT r.request_id, r.ordinal, r.url, CASE WHEN e IS NULL THEN 'T' || page_id ELSE '' END AS title, CASE WHEN e IS NULL THEN ifnull(line2, '') ELSE '' END AS line2, CASE WHEN e IS NULL THEN ifnull(line3, '') ELSE '' END AS line3, e AS error_code FROM ({N.REQUEST_URLS}) r JOIN (SELECT page_id, url, coalesce({N.CRAWL_ERROR}, CASE WHEN n = 0 THEN 'content_extraction_error' END) AS e FROM cnt) USING (url) LEFT JOIN second USING (page_id) LEFT JOIN third USING (page_id)) SELECT * FROM assembled", assembled)


def page_results(s, d) -> DataFrame:
    """Results of fetched pages end to end with their meta, and errors of those that weren't fetched."""
    n = F.col("page_id")
    crawl = N.crawl(s, d)
    problem = S.crawl_error(F.col("status"), F.col("content_type"), F.col("html"), F.col("timed_out"))
    crawl = kept(crawl.select("page_id", "url", F.col("status").alias("http_status"), problem.alias("crawl_error")))
    stages = F.array(*(F.struct(F.lit(k).alias("stage"), ms.cast("double").alias("ms")) for k, ms in (("fetch", n % 100 + 0.5), ("extract", n % 40), ("llm", 100 + n % 7))))
    times = R.page_times(crawl.select("page_id", F.explode(stages).alias("t")).select("page_id", "t.*"))
    fetched = crawl.where("crawl_error is null").select("page_id", "http_status").join(N.rich_pages(s, d).select("page_id", "html"), "page_id").join(times, "page_id")
    done = R.page_results(fetched, N.proposals)
    failed = R.meta_of(crawl.select("http_status"))
    rows = crawl.join(done, "page_id", "left").withColumn("error_code", F.coalesce("crawl_error", "error_code"))
    return rows.select("page_id", "url", "title", "line2", "line3", "error_code", F.coalesce("meta", failed).alias("meta"))


def whole_results(s, d) -> DataFrame:
    """A row for each url of each request; request k asks as event k does, and shows the examples of its owner."""
    urls = S.url_list_explode(N.requests(s, d)).withColumn("ordinal", F.col("ordinal").cast("long"))
    asks = _requests(s, d).join(urls.select("request_id").distinct(), "request_id", "left_semi")
    shown = prompt_examples(s, d).groupBy("owner").agg(F.count("*").alias("example_count"))
    routes = s.createDataFrame([("base", "base-1", "Base"), ("small", "small-2", "Small"), ("large", "large-3", "Large")], "model_id string, model string, label string")
    routed = resolve_route(s, d).join(asks.select("request_id"), "request_id", "left_semi")
    requests = R.request_meta(I.resolve_persona(asks, _settings(s, d)), routed, routes, asks.join(shown, "owner").select("request_id", "example_count"))
    return R.assemble_results(urls, page_results(s, d).drop("page_id"), requests)


_OWN_SOURCES = f"sources AS (SELECT page_id, array_to_string(list_append(list_transform(list_concat(og, list_filter(l, lambda x: NOT list_contains(og, x))), lambda x: {O.cleaned('x')}), {O.cleaned("ifnull(body, '')")}), chr(10)) AS source_text FROM said LEFT JOIN chosen USING (page_id))"
_DONE = f"""{_SAID}{re.sub(r'\bcandidates\b', 'candidates2', _PAIR[len(CHAIN):]).replace(N.SOURCES, _OWN_SOURCES)}, {_TITLE}, listed2 AS (SELECT page_id, count(*) AS n, md5(string_agg(text, chr(10) ORDER BY pos)) AS texts FROM candidates2 GROUP BY page_id),
done AS (SELECT page_id, url, [200, 200, 200, 404, 500][page_id % 5 + 1] AS http_status, ce, coalesce(ce, CASE WHEN n IS NULL THEN 'content_extraction_error' END) AS e, title, title_source, line2, line3, method2, method3, extractor, n, texts
 FROM (SELECT page_id, url, {N.CRAWL_ERROR} AS ce FROM pages) JOIN titles USING (page_id) LEFT JOIN chosen USING (page_id) LEFT JOIN listed2 USING (page_id) LEFT JOIN second USING (page_id) LEFT JOIN third USING (page_id)),
{_LISTED.removeprefix('WITH ')}, shown AS (SELECT owner, count(*) AS example_count FROM listed WHERE place <= 6 GROUP BY owner), ({{persona}}), ({{route}})"""
_DONE = _DONE.replace("({persona})", f"asked AS ({_PERSONA_SQL})").replace("({route})", f"routed AS ({_ROUTE_SQL})")
_ROWS = f"""{_DONE}, result AS (SELECT r.request_id, r.ordinal, r.url, CASE WHEN e IS NULL THEN title ELSE '' END AS title, CASE WHEN e IS NULL THEN ifnull(line2, '') ELSE '' END AS line2, CASE WHEN e IS NULL THEN ifnull(line3, '') ELSE '' END AS line3, e AS error_code,
 CASE WHEN ce IS NULL THEN page_id % 100 + 0.5 END::DOUBLE AS fetch_ms, CASE WHEN ce IS NULL THEN page_id % 40 END::DOUBLE AS extract_ms, CASE WHEN ce IS NULL THEN 100 + page_id % 7 END::DOUBLE AS llm_ms,
 CASE WHEN ce IS NULL THEN page_id % 100 + 0.5 + page_id % 40 + 100 + page_id % 7 END::DOUBLE AS total_ms, http_status, CASE WHEN ce IS NULL THEN ifnull(extractor, 'none') END AS extractor, CASE WHEN ce IS NULL THEN ifnull(n, 0) END AS candidate_count,
 CASE WHEN ce IS NULL THEN texts END AS candidates_md5, CASE WHEN ce IS NULL THEN nullif(title_source, '') END AS title_source, CASE WHEN ce IS NULL THEN method2 END AS line2_match, CASE WHEN ce IS NULL THEN method3 END AS line3_match,
 persona_applied, CASE WHEN v.event_id IS NOT NULL THEN ifnull(example_count, 0) END AS example_count, route AS llm_model_id, CASE route WHEN 'base' THEN 'base-1' WHEN 'small' THEN 'small-2' WHEN 'large' THEN 'large-3' END AS llm_model, upper(route[1]) || route[2:] AS llm_model_label
 FROM ({N.REQUEST_URLS}) r JOIN done USING (url) LEFT JOIN events v ON v.event_id = r.request_id LEFT JOIN asked a ON a.request_id = r.request_id LEFT JOIN routed o ON o.request_id = r.request_id LEFT JOIN shown w ON w.owner = v.event_type)"""


def _flat(rows: DataFrame) -> DataFrame:
    """Meta as columns, the list of candidates as a digest."""
    flat = rows.select(*(c for c in rows.columns if c != "meta"), "meta.*").withColumn("candidate_count", F.col("candidate_count").cast("long")).withColumn("example_count", F.col("example_count").cast("long"))
    return flat.withColumn("candidates_md5", F.when(F.size("candidates") > 0, F.md5(F.array_join("candidates", "\n")))).drop("candidates")


@query("assemble_results", f"{_ROWS} SELECT * FROM result")
def assemble_results(s, d):
    return _flat(whole_results(s, d))


_DIMENSIONS = ("error_code", "extractor", "title_source", "line2_match", "line3_match")


@query("result_breakdown", f"{_ROWS} SELECT dimension, value, count(*) AS n FROM ({' UNION ALL '.join(f"SELECT '{x}' AS dimension, ifnull({x}, '') AS value FROM result" for x in _DIMENSIONS)}) GROUP BY dimension, value")
def result_breakdown(s, d):
    """Counts of results by error, extractor, source of the title and how each line was found."""
    rows = whole_results(s, d).select("error_code", *(f"meta.{x}" for x in _DIMENSIONS[1:]))
    return R.outcome_breakdown(rows, *rows.columns)


@query("write_results", f"{_ROWS} SELECT error_code IS NOT NULL AS failed, request_id, ordinal, url, title, line2, line3, error_code FROM result")
def write_results(s, d):
    """What the sink holds: results, failures in their own folder."""
    path = scratch(s, "results")
    S.write_results(whole_results(s, d), path)
    return s.read.parquet(path).select(F.col("failed").cast("boolean").alias("failed"), "request_id", "ordinal", "url", "title", "line2", "line3", "error_code")


@query("outcome_summary", f"{_OUTCOME} SELECT count(*) AS n_total, count(*) FILTER (error_code IS NULL) AS n_ok, count(error_code) AS n_failed FROM outcomes")
def outcome_summary(s, d):
    return R.outcome_summary(outcomes(s, d))


both_ways("outcome_breakdown", "<pair> SELECT 'method2' AS dimension, method2 AS value, count(*) AS n FROM second GROUP BY method2 UNION ALL SELECT 'method3', method3, count(*) FROM third GROUP BY method3", lambda s, d, fuzzy: R.outcome_breakdown(V.resolve_pair(*verified(s, d), fuzzy=fuzzy), "method2", "method3"))
_LABEL = "CASE WHEN method IN ('exact', 'contained') THEN 'verbatim' WHEN method = 'fuzzy' THEN 'rewritten' WHEN method = 'unverified' THEN 'chosen by score' ELSE method END"
both_ways("match_label", f"<resolved> SELECT page_id, slot, {_LABEL} AS label FROM resolved", lambda s, d, fuzzy: resolve(s, d, fuzzy).select("page_id", "slot", R.match_label(F.col("method")).alias("label")))


@query("stage_timings", """SELECT event_type AS stage, count(*) AS n, round(avg(value), 6) AS avg_ms, max(value) AS max_ms, quantile_disc(value, 0.5) AS median_ms, quantile_disc(value, 0.95) AS p95_ms,
 round(avg(value * (event_id % 5) / 10), 6) AS avg_wait_ms, round(avg(value - value * (event_id % 5) / 10), 6) AS avg_work_ms FROM events GROUP BY event_type""")
def stage_timings(s, d):
    wait = F.col("value") * (F.col("event_id") % 5) / 10
    return R.stage_timings(N.table(s, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms"), wait.alias("wait_ms")))


# Streams

scratch = new_folder


def stream_of(s: SparkSession, d: str, name: str) -> tuple[str, str]:
    """(folder, file pattern) to stream a table from, which is one file or a folder of files."""
    one = N.table(s, d, name).inputFiles()[0]
    return (d, f"{name}.parquet") if one.endswith(f"/{name}.parquet") else (f"{d}/{name}.parquet", "*.parquet")


@query("stream_candidates", f"{_SAID} SELECT page_id, pos, text, match_key FROM candidates2")
def stream_candidates(s, d):
    from ..streaming import jobs

    out = scratch(s, "candidates")
    N.rich_pages(s, d).write.parquet(f"{out}/pages")
    jobs.stream_candidates(s, f"{out}/pages", f"{out}/rows", f"{out}/state")
    return s.read.parquet(f"{out}/rows").select("page_id", F.col("pos").cast("long").alias("pos"), "text", "match_key")


@query("stream_feedback", _RING)
def stream_feedback(s, d):
    from ..streaming import jobs

    out = scratch(s, "feedback")
    folder, pattern = stream_of(s, d, "events")
    events = s.readStream.schema(N.table(s, d, "events").schema).option("pathGlobFilter", pattern).parquet(folder)
    jobs.stream_feedback(N.log_of(events, deletes=True), f"{out}/rows", f"{out}/state")
    return jobs.present_rings(s, f"{out}/rows")


@query("stream_results", f"{_OUTCOME} SELECT o.error_code IS NOT NULL AS failed, request_id, ordinal, r.url, CASE WHEN o.error_code IS NULL THEN 'T' || page_id ELSE '' END AS title, o.error_code FROM ({N.REQUEST_URLS}) r JOIN outcomes o USING (url)")
def stream_results(s, d):
    """Requests come file by file; the last batch runs twice, as after a loss between its write and its commit."""
    from ..streaming import jobs

    out = scratch(s, "requests")
    N.requests(s, d).repartition(3).write.parquet(f"{out}/in")
    done = kept(outcomes(s, d).select("url", F.concat(F.lit("T"), F.col("page_id").cast("string")).alias("title"), F.lit("").alias("line2"), F.lit("").alias("line3"), "error_code"))
    stream = s.readStream.schema("request_id long, urls string").option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
    jobs.stream_results(stream, lambda: done, f"{out}/rows", f"{out}/state")
    rows = s.read.parquet(f"{out}/rows")
    return rows.select(F.col("failed").cast("boolean").alias("failed"), "request_id", F.col("ordinal").cast("long").alias("ordinal"), "url", "title", "error_code")


@query("state_files", """SELECT role AS file, count(*) AS n_examples, count(*) FILTER (line2 = 'p0') AS n_old, max(t) AS last FROM (SELECT role, turn, 'c' || conv_id || '-' || turn AS t, CASE WHEN turn % 2 = 0 THEN role ELSE 'p0' END AS line2 FROM conversations) GROUP BY role
 UNION ALL SELECT 'bad', 0, 0, NULL""")
def state_files(s, d):
    """A state file for each role, old and new examples mixed, and one file that is cut off."""
    c, out = N.table(s, d, "conversations"), scratch(s, "state")
    title = F.concat(F.lit('{"title":"c'), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit('",'))
    item = F.concat(title, F.when(F.col("turn") % 2 == 0, F.concat(F.lit('"line2":"'), "role", F.lit('"}'))).otherwise('"catchphrase_parts":["p0","p1"]}'))
    whole = F.concat(F.lit('{"version":1,"active_prompt":"'), "role", F.lit('","examples":['), F.array_join(F.collect_list("item"), ","), F.lit("]}"))
    files = c.select("role", item.alias("item")).groupBy("role").agg(whole.alias("value"))
    files = files.unionByName(s.createDataFrame([("bad", '{"examples":[{"title"')], "role string, value string"))
    files.write.partitionBy("role").option("lineSep", " ").text(out)
    read = A.state_files(s, out)
    name = F.regexp_extract("file", "role=([^/]*)", 1).alias("file")
    found = A.examples_of(read).groupBy("file").agg(F.count("*").alias("n_examples"), F.count_if(F.col("line2") == "p0").alias("n_old"), F.max("title").alias("last"))
    bad = read.where("quarantined").select("file", F.lit(0).cast("long").alias("n_examples"), F.lit(0).cast("long").alias("n_old"), F.lit(None).cast("string").alias("last"))
    return found.unionByName(bad).withColumn("file", name)
