"""The SQL that each registered query is compared with, from shared steps."""

from __future__ import annotations

import re

from ..profiles import BLOCK_TAGS, CHARSET_ALIASES, LATIN, NOISE_HINTS, NOISE_ROLES, NOISE_TAGS
from ..sources.crawl import HTML_TYPES

P = LATIN
# The SQL has its own patterns, so that a wrong one in the operators shows.
RAW = "(?is)<!--.*?(?:-->|$)" + "".join(f"|<{t}[\\s/>].*?(?:</{t}[\\s]*>|$)" for t in ("textarea", "template", "noscript", "style", "script"))
# Alternatives in order of preference: a value in quotes, then any other character of the tag.
TOKEN = """(?s)</?[A-Za-z](?:=\\s*"[^"]*"|=\\s*'[^']*'|[^>])*(?:>|$)|<[/?!][^>]*(?:>|$)|(?:[^<]|<(?:[^<A-Za-z/?!]|$))+"""
VOID_TAGS = tuple("wbr track source meta link input img hr embed col br base area".split())
IMPLIED_ENDS = tuple("dd dt th td tr li p".split())
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "#39": "'", "apos": "'", "middot": "·", "copy": "©", "eacute": "é", "#233": "é", "amp": "&"}
# An attribute with its name and its value, with quotes, as groups.
NAMED = """[\\s/]+([^\\s"'<>/=]+)(?:\\s*=\\s*("[^"]*"|'[^']*'|[^\\s"'>][^\\s>]*))?"""


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def among(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(map(lit, words)) + ")"


def unescaped(x: str) -> str:
    for name, value in ENTITIES.items():
        x = f"replace({x}, {lit(f'&{name};')}, {lit(value)})"
    return x


def replaced(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(by)}, 'g')"


def trimmed(x: str) -> str:
    return replaced(x, "^\\s+|\\s+$")


def normalized(x: str) -> str:
    x = replaced(replaced(x, "\r\n?", "\n"), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]")
    x = replaced(replaced(x, "[ \t\\x{00a0}]+", " "), "(?m)^ | $")
    return trimmed(replaced(x, "\n{3,}", "\n\n"))


def stripped(x: str) -> str:
    return unescaped(replaced(x, "<[^>]*>", " "))


def cleaned(x: str) -> str:
    return normalized(stripped(x))


def key(x: str) -> str:
    return f"lower({replaced(x, '\\s')})"


def has_any(x: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def count_of(x: str, words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains({x}, {lit(w)})::INT" for w in words) + ")"


def script(text: str) -> str:
    return f"len(regexp_extract_all({text}, '\\p{{Latin}}'))"


def bare(x: str) -> str:
    return replaced(x, "[\\s\\pP]")


def promo(x: str) -> str:
    return has_any(f"lower({x})", P.promo)


def noise(x: str) -> str:
    times = lambda c: f"(length({x}) - length(replace({x}, {lit(c)}, '')))"
    return (
        f"({times('|')} >= 3 OR {times('＞')} >= 2 OR {times('>')} >= 3 OR {has_any(f'lower({x})', P.noise)} OR {promotional(x)} "
        f"OR NOT regexp_matches({x}, '\\p{{Latin}}') OR CASE WHEN length({bare(x)}) = 0 THEN 0 ELSE {script(bare(x))} / length({bare(x)}) END < {P.min_script_ratio})"
    )


def promotional(x: str) -> str:
    return f"(regexp_matches({x}, {lit(P.price)}) OR regexp_matches({x}, {lit(P.percent_off)}) OR regexp_matches({x}, {lit(P.points)}))"


SENTENCE = f"[^{P.terminators}]*[{P.terminators}][{P.closers}]*|[^{P.terminators}]+"
EDGE = "[" + "".join("\\" + c if c in "\\/|*+~-" else c for c in P.decoration) + "]+"


def affix_step(s: str) -> str:
    tries = []
    for a, b in P.brackets:
        q = lambda c: "\\" + c
        lead, tail = f"(?s)^{q(a)}(.*?){q(b)}", f"(?s)^(.*){q(a)}(.*){q(b)}$"
        tries.append(f"WHEN starts_with({s}, {lit(a)}) AND regexp_matches({s}, {lit(lead)}) AND {promo(f'regexp_extract({s}, {lit(lead)}, 1)')} THEN {trimmed(f'regexp_replace({s}, {lit(lead)}, {lit("")})')}")
        tries.append(f"WHEN ends_with({s}, {lit(b)}) AND regexp_matches({s}, {lit(tail)}) AND {promo(f'regexp_extract({s}, {lit(tail)}, 2)')} THEN {trimmed(f'regexp_extract({s}, {lit(tail)}, 1)')}")
    return f"CASE {' '.join(tries)} ELSE {trimmed(replaced(s, f'^{EDGE}|{EDGE}$'))} END"


def sentence_steps(source: str, group: str) -> str:
    """CTEs from ``source`` (group, source_no, raw) to ``pieces`` (group, source_no, sent_no, piece_no, text) and ``usable``."""
    return f"""
cleanrows AS (SELECT {group}, source_no, {cleaned('raw')} AS clean FROM {source} WHERE raw IS NOT NULL),
linerows AS (SELECT {group}, source_no, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM (SELECT *, string_split(clean, chr(10)) AS l FROM cleanrows)),
sentraw AS (SELECT {group}, source_no, line_no, unnest(l) AS s, generate_subscripts(l, 1) AS k FROM (SELECT *, regexp_extract_all(line, {lit(SENTENCE)}) AS l FROM linerows)),
sents AS (SELECT {group}, source_no, {trimmed('s')} AS sentence, row_number() OVER (PARTITION BY {group}, source_no ORDER BY line_no, k) - 1 AS sent_no FROM sentraw WHERE {trimmed('s')} <> ''),
affix AS (SELECT {group}, source_no, sent_no, sentence AS s, 0 AS round FROM sents UNION ALL SELECT {group}, source_no, sent_no, n, round + 1 FROM (SELECT *, {affix_step('s')} AS n FROM affix) WHERE n <> s),
bares AS (SELECT {group}, source_no, sent_no, arg_max(s, round) AS sentence FROM affix GROUP BY ALL HAVING arg_max(s, round) <> ''),
longs AS (
  SELECT {group}, source_no, sent_no, 0 AS piece_no, CASE WHEN length(sentence) <= {P.max_chars} THEN sentence END AS text, CASE WHEN length(sentence) > {P.max_chars} THEN sentence ELSE '' END AS rest FROM bares
  UNION ALL
  SELECT {group}, source_no, sent_no, piece_no + 1, CASE WHEN length(rest) <= {P.max_chars} THEN rest ELSE {trimmed('rest[1:cut]')} END, CASE WHEN length(rest) <= {P.max_chars} THEN '' ELSE {trimmed('rest[cut+1:]')} END
  FROM (SELECT *, CASE WHEN back IS NULL OR {P.max_chars} - back < {P.max_chars // 3} THEN {P.max_chars} ELSE {P.max_chars} - back + 1 END AS cut FROM (
    SELECT *, nullif(least(ifnull(nullif(instr(reverse(rest[1:{P.max_chars}]), ','), 0), 9999), ifnull(nullif(instr(reverse(rest[1:{P.max_chars}]), ';'), 0), 9999), ifnull(nullif(instr(reverse(rest[1:{P.max_chars}]), ':'), 0), 9999)), 9999) AS back FROM longs WHERE rest <> ''))
),
pieces AS (SELECT {group}, source_no, sent_no, text, row_number() OVER (PARTITION BY {group}, source_no, sent_no ORDER BY piece_no) - 1 AS piece_no FROM longs WHERE text IS NOT NULL AND text <> ''),
usable AS (SELECT *, {key('text')} AS match_key FROM pieces WHERE length(text) >= {P.min_chars} AND NOT {noise('text')}),
uniq AS (SELECT * FROM usable WHERE match_key <> '' QUALIFY row_number() OVER (PARTITION BY {group}, match_key ORDER BY source_no, sent_no, piece_no) = 1),
candidates AS (SELECT {group}, row_number() OVER (PARTITION BY {group} ORDER BY source_no, sent_no, piece_no) - 1 AS pos, text, match_key FROM uniq QUALIFY pos < {P.limit})"""


def renamed_steps(source: str, group: str) -> str:
    """``sentence_steps`` for a statement that has them already: every name with 2 behind it."""
    out = sentence_steps(source, group)
    for name in ("cleanrows", "linerows", "sentraw", "sents", "affix", "bares", "longs", "pieces", "usable", "uniq", "candidates"):
        out = re.sub(rf"\b{name}\b", name + "2", out)
    return out


def attribute(token: str, name: str) -> str:
    """Names and values of the tag as two lists; the value at the place of the name, without its quotes."""
    names = f"list_transform(regexp_extract_all({token}, {lit(NAMED)}, 1), lambda a: lower(a))"
    value = f"ifnull(regexp_extract_all({token}, {lit(NAMED)}, 2)[list_position({names}, {lit(name)})], '')"
    return f"CASE WHEN left({value}, 1) IN ('\"', {lit(chr(39))}) THEN {value}[2:-2] ELSE {value} END"


TOKENS = f"""
toklist AS (SELECT page_id, regexp_extract_all(replace(replace({replaced('html', RAW, ' ')}, '<<', chr(1) || '<'), '<<', chr(1) || '<'), {lit(TOKEN)}) AS l FROM pages),
rawtok AS (SELECT page_id, replace(unnest(l), chr(1), '<') AS token, generate_subscripts(l, 1) - 1 AS pos FROM toklist),
tagtok AS (SELECT *, lower(regexp_extract(token, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM rawtok),
tokens AS (SELECT page_id, pos, tag, token, CASE WHEN regexp_matches(token, '^</[a-zA-Z]') THEN 'close' WHEN regexp_matches(token, '^<[a-zA-Z]') THEN CASE WHEN tag IN {among(VOID_TAGS)} OR regexp_matches(token, '/>$') THEN 'void' ELSE 'open' END WHEN token[1] = '<' AND token[2] IN ('!', '?', '/') THEN 'void' ELSE 'text' END AS kind FROM tagtok)"""

BY_TAG = f"tag IN {among(NOISE_TAGS)}"
BY_ROLE = f"lower({attribute('token', 'role')}) IN {among(NOISE_ROLES)}"
BY_HINT = has_any(f"lower(concat_ws(' ', {attribute('token', 'class')}, {attribute('token', 'id')}))", NOISE_HINTS)


def depth_steps(source: str, start: str, name: str) -> str:
    """CTEs that give ``name``: the tokens of ``source`` with depth, the number of elements with such an open tag that hold each. By intervals: every
    start is matched with the first close tag of its level, and tokens count the intervals over them."""
    return f"""
{name}_lv AS (SELECT *, sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id, tag ORDER BY pos) + CASE WHEN kind = 'close' THEN 1 ELSE 0 END AS level, kind IN ('open', 'void') AND ({start}) AS starts FROM {source}),
{name}_iv AS (SELECT page_id, pos, CASE WHEN kind = 'void' THEN pos ELSE ifnull(lead(pos) OVER (PARTITION BY page_id, tag, level, kind IN ('open', 'close') ORDER BY pos), 1073741824) END AS ending, starts FROM {name}_lv),
{name} AS (SELECT t.page_id, t.pos, t.kind, t.tag, t.token, count(i.pos) AS depth FROM {source} t LEFT JOIN (SELECT * FROM {name}_iv WHERE starts) i ON i.page_id = t.page_id AND t.pos BETWEEN i.pos AND i.ending GROUP BY ALL)"""


def piece_step(source: str, name: str) -> str:
    feed = f"tag = 'br' OR (kind = 'close' AND tag IN {among(BLOCK_TAGS)}) OR (kind = 'open' AND tag IN {among(IMPLIED_ENDS)})"
    return f"{name} AS (SELECT page_id, pos, CASE WHEN kind = 'text' THEN {unescaped('token')} WHEN {feed} THEN chr(10) END AS piece FROM {source} WHERE kind = 'text' OR {feed})"


KEPT = f"{TOKENS}, {depth_steps('tokens', f'{BY_TAG} OR {BY_ROLE} OR {BY_HINT}', 'noisy')}, kepttok AS (SELECT page_id, pos, kind, tag, token FROM noisy WHERE depth = 0)"
FULL = f"{KEPT}, {piece_step('kepttok', 'fullpieces')}, fulltext AS (SELECT page_id, string_agg(piece, ' ' ORDER BY pos) AS text FROM fullpieces GROUP BY page_id)"


def candidate_chain() -> str:
    """WITH ... candidates of every page's denoised text."""
    return f"WITH RECURSIVE {FULL}, src AS (SELECT page_id, 0 AS source_no, text AS raw FROM fulltext), {sentence_steps('src', 'page_id')}"


def score(text: str, pos: str) -> str:
    n = f"length({text})"
    return (
        f"round((CASE WHEN {n} BETWEEN 15 AND 80 THEN 3.0::DOUBLE WHEN {n} < 15 THEN (15 - {n}) * -0.2::DOUBLE ELSE ({n} - 80) * -0.05::DOUBLE END) + ({count_of(text, P.appeal)} * 1.5::DOUBLE - {count_of(text, P.weak)} * 1.5::DOUBLE) "
        f"+ CASE WHEN {n} > 0 AND len(regexp_extract_all({text}, '[0-9０-９]')) / {n} > 0.25 THEN -3.0::DOUBLE ELSE 0 END + CASE WHEN right({text}, 1) IN ('.', '!', '?') THEN 1.0::DOUBLE ELSE 0 END - {pos} * 0.05::DOUBLE, 6)"
    )


def meta(attr: str, value: str, html: str = "html") -> str:
    tags = f"list_filter(regexp_extract_all({html}, {lit(TOKEN)}), lambda t: lower(t[1:5]) = '<meta' AND lower({attribute('t', attr)}) = {lit(value)})"
    content = replaced(unescaped(attribute("t", "content")), "\\s+", " ")
    return f"list_filter(list_transform({tags}, lambda t: trim({content})), lambda c: c <> '')"


def host(u: str) -> str:
    return f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[.*?\\]|[^/?#:]+)', 1)"


def url_problem(u: str) -> str:
    scheme = f"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
    return f"CASE WHEN {u} = '' THEN 'empty' WHEN length({u}) > 2048 THEN 'too_long' WHEN {scheme} NOT IN ('http', 'https') THEN 'scheme' WHEN {host(u)} = '' THEN 'no_host' END"


TYPES = HTML_TYPES
ALIASES = CHARSET_ALIASES


def alike(name: str, queries: str, candidates: str, least: float) -> str:
    """CTEs of ``name`` (page_id, slot, text, ratio): of each query the candidate of the highest ratio of matching blocks, of ``least`` or more, the first of equals.

    Blocks by recursion: of a segment of both texts the longest common stretch, the leftmost of equals, then what lies on either side of it."""
    common = "ifnull(list_position(list_transform(range(0, least(ahi - i, bhi - j)), lambda x: a[i + x] <> b[j + x]), true) - 1, least(ahi - i, bhi - j))"
    begins = "a[i] = b[j] AND (i = alo OR j = blo OR a[i - 1] <> b[j - 1])"
    longest = f"list_min(flatten(list_transform(range(alo, ahi), lambda i: list_transform(list_filter(range(blo, bhi), lambda j: {begins}), lambda j: {{'k': -{common}, 'i': i, 'j': j}}))))"
    shared = "list_sum(list_transform(list_distinct(a), lambda c: least(len(list_filter(a, lambda x: x = c)), len(list_filter(b, lambda x: x = c)))))"
    return f"""{name}_all AS (SELECT q.page_id, slot, pos, c.text, string_split(match_key, '') AS a, string_split(query, '') AS b FROM {queries} q JOIN {candidates} c ON q.page_id = c.page_id
 WHERE length(query) >= {P.min_fuzzy_chars} AND match_key <> '' AND 2.0 * least(length(query), length(match_key)) / (length(query) + length(match_key)) >= {least}),
{name}_pairs AS MATERIALIZED (SELECT *, row_number() OVER () AS id FROM {name}_all WHERE 2.0 * {shared} / (len(a) + len(b)) >= {least}),
{name}_seg AS (SELECT id, 1::BIGINT AS alo, len(a)::BIGINT + 1 AS ahi, 1::BIGINT AS blo, len(b)::BIGINT + 1 AS bhi, 0::BIGINT AS hit FROM {name}_pairs
 UNION ALL SELECT id, n.alo, n.ahi, n.blo, n.bhi, n.hit FROM (SELECT id, unnest([{{'alo': alo, 'ahi': m.i, 'blo': blo, 'bhi': m.j, 'hit': -m.k}}, {{'alo': m.i - m.k, 'ahi': ahi, 'blo': m.j - m.k, 'bhi': bhi, 'hit': 0}}]) AS n
 FROM (SELECT id, alo, ahi, blo, bhi, {longest} AS m FROM {name}_seg JOIN {name}_pairs USING (id) WHERE alo < ahi AND blo < bhi) WHERE m IS NOT NULL)),
{name}_hits AS (SELECT id, sum(hit) AS hits FROM {name}_seg GROUP BY id),
{name}_rated AS (SELECT page_id, slot, pos, text, 2.0::DOUBLE * hits / (len(a) + len(b)) AS ratio FROM {name}_pairs JOIN {name}_hits USING (id)),
{name} AS (SELECT page_id, slot, text, ratio FROM {name}_rated WHERE ratio >= {least} QUALIFY row_number() OVER (PARTITION BY page_id, slot ORDER BY ratio DESC, pos) = 1)"""
