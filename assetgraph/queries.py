"""The registered queries for the engine's own operators, and their SQL.

"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.canonical import fingerprint
from .functions.predicates import freshness, is_inactive, is_usable, rank_of
from .functions import text as rules
from .functions.text import CATEGORIES, estimate_tokens, has_secret, hidden_count, hidden_places, host_of, normalize_space, path_of, text_hash
from .operators import aggregates, diff, duplicates, graph, joins, policy, sets, windows
from .plans import posture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TODAY = "1999-06-30"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- text

CJK = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}"
BLANK = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
TOKENS_SQL = f"CAST(len(regexp_extract_all(text, '[{CJK}]{{1,2}}')) + len(regexp_extract_all(regexp_replace(text, '[{CJK}]', ' ', 'g'), '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_./:+\\-=]*|[^{BLANK}\\p{{L}}\\p{{N}}_]{{1,3}}')) AS BIGINT)"


@query(f"SELECT doc_id, coalesce({TOKENS_SQL}, 0) AS est_tokens FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    """F1"""
    return table(spark, d, "documents").select("doc_id", estimate_tokens(F.col("text")).alias("est_tokens"))


@query(f"""
SELECT source, lang, CAST(count(*) AS BIGINT) AS n_docs, CAST(count(*) FILTER (t > 800 AND t <= 2000) AS BIGINT) AS n_warning, CAST(count(*) FILTER (t > 2000) AS BIGINT) AS n_high,
  CAST(sum(greatest(t - 2000, 0)) AS BIGINT) AS overage
FROM (SELECT source, lang, {TOKENS_SQL} AS t FROM documents) GROUP BY source, lang
""")
def token_budget_tiers(spark: SparkSession, d: str) -> DataFrame:
    """F1, P13, F23"""
    t = table(spark, d, "documents").select("source", "lang", estimate_tokens(F.col("text")).alias("t"))
    return t.groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.count_if((F.col("t") > 800) & (F.col("t") <= 2000)).alias("n_warning"), F.count_if(F.col("t") > 2000).alias("n_high"), F.sum(F.greatest(F.col("t") - 2000, F.lit(0))).alias("overage"))


LINES_SQL = r"SELECT doc_id, source, unnest(range(1, len(x) + 1)) AS line, unnest(x) AS content FROM (SELECT doc_id, source, string_split_regex(text, '\r\n|\n|\r') AS x FROM documents)"
_RE = {k: v.replace("'", "''") for k, v in vars(rules).items() if k.isupper() and isinstance(v, str)}
KEY_SQL = f"regexp_matches(content, '{_RE['PRIVATE_KEY_LINE']}')"
SECRET_SQL = f"(regexp_matches(content, '{_RE['SECRET_LINE']}') AND NOT regexp_matches(content, '{_RE['PLACEHOLDER']}') AND NOT {KEY_SQL})"
REMOTE_SQL = f"(regexp_matches(content, '{_RE['REMOTE_LINE']}') AND NOT regexp_matches(content, '{_RE['IGNORED_LINE']}'))"
ENV_SQL = f"(regexp_matches(content, '{_RE['ENV_COPY_LINE']}') AND NOT regexp_matches(content, '{_RE['IGNORED_LINE']}') AND NOT regexp_matches(content, '{_RE['REMOTE_LINE']}'))"


def _normal_sql(text: str) -> str:
    return f"trim(regexp_replace({text}, '[{BLANK}]+', ' ', 'g'))"


# A flag written with tags counts, with its six tags, only between two characters of one token.  These patterns are written apart from the engine's.
_FLAG = r"\x{1F3F4}\x{E0067}\x{E0062}(?:\x{E0065}\x{E006E}\x{E0067}|\x{E0073}\x{E0063}\x{E0074}|\x{E0077}\x{E006C}\x{E0073})\x{E007F}"
_TOK = r"[-A-Za-z0-9_./:@%+=]"


def _clean_sql(text: str, begins: str) -> str:
    free = f"regexp_replace({text}, '{_FLAG}', '\U0001f3f4', 'g')"
    return f"CASE WHEN {begins} THEN regexp_replace({free}, '^\\x{{FEFF}}', '') ELSE {free} END"


def _embedded_sql(text: str) -> str:
    parts = f"string_split_regex({text}, '{_FLAG}')"
    return f"(CASE WHEN contains({text}, '\U0001f3f4') THEN len(list_filter(range(1, len({parts})), lambda fi: regexp_matches({parts}[fi], '{_TOK}$') AND regexp_matches({parts}[fi + 1], '^{_TOK}'))) ELSE 0 END)"


HIDDEN_SQL = f"(regexp_matches({_clean_sql('content', 'line = 1')}, '{_RE['INVISIBLE']}|{_RE['VARIATION_RUN']}|{_RE['ASCII_TOKEN']}{_RE['JOINERS']}{_RE['ASCII_TOKEN']}') OR {_embedded_sql('content')} > 0)"


@query(rf"SELECT doc_id, CAST(line AS INTEGER) AS line, sha256({_normal_sql('content')}) AS snippet_hash FROM ({LINES_SQL}) WHERE {SECRET_SQL}")
def line_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    """F7, F3, F4"""
    lines = duplicates.exploded_lines(table(spark, d, "documents"), "doc_id", "text")
    return lines.where(has_secret(F.col("content"))).select("doc_id", "line", text_hash(normalize_space(F.col("content"))).alias("snippet_hash"))


@query(f"""
WITH c AS (SELECT text, {_clean_sql('text', 'TRUE')} AS x FROM documents WHERE text IS NOT NULL
), j AS (SELECT sum(len(list_filter(range(2, length(x)), lambda i: regexp_matches(substr(x, i - 1, 3), '^{_RE['ASCII_TOKEN']}{_RE['JOINERS']}{_RE['ASCII_TOKEN']}$')))) AS n FROM c WHERE regexp_matches(x, '{_RE['JOINERS']}'))
SELECT 'bidi_control' AS category, CAST(coalesce(sum(len(regexp_extract_all(text, '{_RE['BIDI']}'))), 0) AS BIGINT) AS n FROM c
UNION ALL
SELECT 'invisible_character', CAST(coalesce(sum(len(regexp_extract_all(x, '{_RE['INVISIBLE']}')) + 6 * {_embedded_sql('text')} + length(x) - length(regexp_replace(x, '{_RE['VARIATION_RUN']}', '', 'g'))), 0) + coalesce((SELECT n FROM j), 0) AS BIGINT) FROM c
""")
def hidden_unicode_scan(spark: SparkSession, d: str) -> DataFrame:
    """F6, A8"""
    sums = table(spark, d, "documents").agg(*(F.coalesce(F.sum(hidden_count(F.col("text"), c)), F.lit(0)).alias(c) for c in CATEGORIES))
    return sums.unpivot([], list(CATEGORIES), "category", "n")


# Lines made of customers, with hidden characters between and inside words.
HIDDEN_PARTS = (
    "concat(c_name, chr(8203), c_mktsegment, chr(8238))",
    "concat('a', chr(8205), 'b', chr(8205), ' ', c_name, chr(65279))",
    "concat(chr(65279), c_mktsegment, chr(127988), chr(917607), chr(917602), chr(917605), chr(917614), chr(917607), chr(917631), ' ')",
    "concat('x', chr(127988), chr(917607), chr(917602), chr(917619), chr(917603), chr(917620), chr(917631), 'y', chr(65039), chr(65038))",
    "concat(c_name, chr(128512), chr(8204), 'z', chr(173))",
    "c_name",
)
_HIDDEN_LINES = f"SELECT c_custkey AS id, CASE c_custkey % {len(HIDDEN_PARTS)} {' '.join(f'WHEN {i} THEN {p}' for i, p in enumerate(HIDDEN_PARTS))} END AS content"


@query(rf"""
WITH l AS (SELECT 'document' AS origin, doc_id AS id, CAST(line AS INTEGER) AS line, content FROM ({LINES_SQL}) UNION ALL SELECT 'customer', id, 1, content FROM ({_HIDDEN_LINES} FROM customer)
), c AS (SELECT *, unnest(range(1, length(content) + 1)) AS i FROM l WHERE regexp_matches(content, '[^\x09\x20-\x7E]')
), p AS (SELECT *, content[i] AS x, CASE WHEN i > 1 THEN content[i - 1] ELSE '' END AS before, content[i + 1] AS after,
    len(list_filter(range(greatest(1, i - 6), i), lambda k: regexp_matches(content[k : k + 6], '^{_FLAG}$') AND NOT (k > 1 AND regexp_matches(content[k - 1], '^{_TOK}$') AND regexp_matches(content[k + 7], '^{_TOK}$')))) > 0 AS in_flag FROM c
), k AS (SELECT *, CASE WHEN regexp_matches(x, '[\x{{202A}}-\x{{202E}}\x{{2066}}-\x{{2069}}]') THEN 'bidi_control'
    WHEN line = 1 AND i = 1 AND ord(x) = 65279 THEN NULL WHEN in_flag THEN NULL
    WHEN ord(x) < 9 OR ord(x) IN (11, 12) OR ord(x) BETWEEN 14 AND 31 OR ord(x) BETWEEN 127 AND 159 OR ord(x) BETWEEN 917504 AND 917631 OR ord(x) IN (173, 847, 8203, 8288, 65279) OR ord(x) BETWEEN 8298 AND 8303 OR ord(x) BETWEEN 65529 AND 65531 THEN 'invisible_character'
    WHEN ord(x) IN (8204, 8205) AND regexp_matches(before, '^{_TOK}$') AND regexp_matches(after, '^{_TOK}$') THEN 'invisible_character'
    WHEN regexp_matches(x, '[\x{{180B}}-\x{{180D}}\x{{180F}}\x{{FE00}}-\x{{FE0F}}\x{{E0100}}-\x{{E01EF}}]') AND regexp_matches(before || after, '[\x{{180B}}-\x{{180D}}\x{{180F}}\x{{FE00}}-\x{{FE0F}}\x{{E0100}}-\x{{E01EF}}]') THEN 'invisible_character' END AS category FROM p)
SELECT origin, id, line, CAST(length(content[1 : i - 1]) + len(regexp_extract_all(content[1 : i - 1], '[\x{{10000}}-\x{{10FFFF}}]')) AS INTEGER) AS start, category, CAST(ord(x) AS INTEGER) AS code_point FROM k WHERE category IS NOT NULL
""")
def hidden_unicode_places(spark: SparkSession, d: str) -> DataFrame:
    """every hidden character with its place"""
    lines = duplicates.exploded_lines(table(spark, d, "documents"), "doc_id", "text").select(F.lit("document").alias("origin"), F.col("doc_id").alias("id"), "line", "content")
    # chr of Spark stops at 255, so code points are decoded
    made = re.sub(r"chr\((\d+)\)", lambda m: f"decode(X'{chr(int(m[1])).encode('utf-16-be').hex()}', 'UTF-16BE')", _HIDDEN_LINES.removeprefix("SELECT c_custkey AS id, "))
    made = table(spark, d, "customer").selectExpr("'customer' AS origin", "c_custkey AS id", "1 AS line", made)
    return hidden_places(lines.unionByName(made))


FINDINGS_SQL = f"""
SELECT doc_id, path, f.rule_id AS rule_id, f.severity AS severity, line FROM (
  SELECT doc_id, source || '/' || doc_id AS path, line, unnest([
    CASE WHEN {KEY_SQL} THEN {{'rule_id': 'private_key', 'severity': 'critical'}} END, CASE WHEN {SECRET_SQL} THEN {{'rule_id': 'literal_secret', 'severity': 'high'}} END,
    CASE WHEN {REMOTE_SQL} THEN {{'rule_id': 'remote_default', 'severity': 'medium'}} END, CASE WHEN {ENV_SQL} THEN {{'rule_id': 'env_copy', 'severity': 'medium'}} END,
    {', '.join(f"CASE WHEN regexp_matches(content, '{p}') THEN {{'rule_id': '{i}', 'severity': '{s}'}} END" for i, s, p in posture.LINE_RULES)},
    CASE WHEN regexp_matches(content, '{_RE['BIDI']}') THEN {{'rule_id': 'hidden_bidi_control', 'severity': 'high'}} END, CASE WHEN {HIDDEN_SQL} THEN {{'rule_id': 'hidden_invisible_character', 'severity': 'medium'}} END
  ]) AS f FROM ({LINES_SQL})
) WHERE f IS NOT NULL
"""
SUPPRESSED_SQL = "CASE WHEN rule_id = 'phone_number' AND regexp_matches(path, '^src1[^/]*/.*$') THEN 0 WHEN rule_id = 'license_notice' AND regexp_matches(path, '^src3(/.*)?$') THEN 2 END"
RANK_SQL = "CASE severity WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 WHEN 'critical' THEN 3 END"


@query(f"""
SELECT rule_id AS finding_id, CAST(count(*) AS BIGINT) AS n, ['low', 'medium', 'high', 'critical'][max({RANK_SQL}) + 1] AS max_severity
FROM (SELECT *, {SUPPRESSED_SQL} AS s FROM ({FINDINGS_SQL})) WHERE s IS NULL GROUP BY rule_id ORDER BY n DESC, max({RANK_SQL}) DESC, finding_id LIMIT 10
""")
def security_posture_topk(spark: SparkSession, d: str) -> DataFrame:
    """U1, R4, J10, A5, T4"""
    return posture.posture_topk(table(spark, d, "documents"), TODAY)


@query(f"SELECT rule_id, suppressed, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs FROM (SELECT *, ({SUPPRESSED_SQL}) IS NOT NULL AS suppressed FROM ({FINDINGS_SQL})) GROUP BY rule_id, suppressed")
def suppression_split(spark: SparkSession, d: str) -> DataFrame:
    """J10, P5, W3"""
    rows = joins.apply_suppressions(posture.line_findings(table(spark, d, "documents")), posture.SUPPRESSIONS, TODAY)
    return rows.groupBy("rule_id", F.col("suppressed_by").isNotNull().alias("suppressed")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query(r"""
SELECT doc_id, CAST(len(list_filter(r, lambda x: x[1])) AS INTEGER) AS risky, CAST(len(list_filter(r, lambda x: x[1] AND x[2])) AS INTEGER) AS guarded FROM (
  SELECT doc_id, list_transform(range(1, len(x) + 1), lambda i: [regexp_matches(x[i], 'password|token|AKIA'), len(list_filter(x[greatest(1, i - 2) : i], lambda l: regexp_matches(l, '(?i)licensed|not|no '))) > 0]) AS r
  FROM (SELECT doc_id, string_split_regex(text, '\r\n|\n|\r') AS x FROM documents)
) WHERE len(list_filter(r, lambda x: x[1])) > 0
""")
def guard_lookback(spark: SparkSession, d: str) -> DataFrame:
    """W4"""
    lines = F.split("text", "\r\n|\n|\r")
    rows = table(spark, d, "documents").where(F.col("text").rlike("password|token|AKIA")).select("doc_id", lines.alias("lines"))
    return rows.select("doc_id", windows.guarded(F.col("lines"), "password|token|AKIA", "(?i)licensed|not|no ").alias("g")).select("doc_id", "g.risky", "g.guarded").where("risky > 0")


# ---- duplicates


@query(f"""
SELECT sha256({_normal_sql('text')}) AS key, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs, CAST(count(*) AS BIGINT) AS n_rows
FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2
""")
def exact_duplicate_text(spark: SparkSession, d: str) -> DataFrame:
    """A9"""
    docs = table(spark, d, "documents").where("text is not null")
    return duplicates.duplicate_groups(docs, text_hash(normalize_space(F.col("text"))), "doc_id", 2)


@query(f"""
SELECT sha256(content) AS key, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs, CAST(count(*) AS BIGINT) AS n_rows FROM ({LINES_SQL}) WHERE length(content) >= 24
GROUP BY content HAVING count(DISTINCT doc_id) >= 3
""")
def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    """A9"""
    lines = duplicates.exploded_lines(table(spark, d, "documents"), "doc_id", "text").where(F.length("content") >= 24)
    return duplicates.duplicate_groups(lines, text_hash(F.col("content")), "doc_id", 3)


_COMMON = ", ".join(f"'{w}'" for w in duplicates.COMMON_TOKENS)
SHINGLES_SQL = rf"""
WITH l AS (SELECT doc_id, line, regexp_extract_all(lower(content), '[{CJK}]{{1,2}}|[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_./:+\-=]*|[^{BLANK}\p{{L}}\p{{N}}_]{{1,3}}') AS u FROM ({LINES_SQL})
), t AS (SELECT doc_id, flatten(list(u ORDER BY line)) AS w, flatten(list(list_transform(u, lambda x: line) ORDER BY line)) AS ln FROM l GROUP BY doc_id
), p AS (SELECT doc_id, w, ln, unnest(range(1, len(w) - 38)) AS i FROM t WHERE len(w) >= 40
), s AS (
  SELECT doc_id, min(i) AS i, any_value(ln) AS ln, k FROM (SELECT doc_id, i, ln, array_to_string(w[i : i + 39], ' ') AS k FROM p
    WHERE len(list_distinct(w[i : i + 39])) >= 12 AND len(list_filter(w[i : i + 39], lambda x: x NOT IN ({_COMMON}))) >= 14) WHERE length(k) >= 140 GROUP BY doc_id, k
), g AS (
  SELECT k, count(*) AS n_docs, list({{'path': doc_id, 'start_line': ln[i], 'end_line': ln[i + 39]}} ORDER BY doc_id, ln[i]) AS p FROM s GROUP BY k HAVING count(*) >= 3
)"""


@query(f"{SHINGLES_SQL} SELECT sha256(k) AS key, CAST(n_docs AS BIGINT) AS n_docs, p[1].path AS first_doc, CAST(p[1].start_line AS INTEGER) AS start_line, CAST(p[1].end_line AS INTEGER) AS end_line FROM g")
def token_shingles(spark: SparkSession, d: str) -> DataFrame:
    """A10"""
    groups = duplicates.shingle_groups(duplicates.token_windows(table(spark, d, "documents"), "doc_id", "text"), "doc_id")
    return groups.select(text_hash(F.col("key")).alias("key"), "n_docs", F.col("path").alias("first_doc"), "start_line", "end_line")


def collapsed(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.collapse_shingles(duplicates.shingle_groups(duplicates.token_windows(table(spark, d, "documents"), "doc_id", "text"), "doc_id"))


@query()
def near_dup_collapse(spark: SparkSession, d: str) -> DataFrame:
    """The groups of repeated token windows that are left after the collapse, all of them"""
    return collapsed(spark, d).select(text_hash(F.col("key")).alias("key"), F.col("path").alias("first_doc"), "start_line", "end_line", "n_docs")


@query()
def repeated_context_report(spark: SparkSession, d: str) -> DataFrame:
    """The ten groups that a report lists"""
    return duplicates.ranked_groups(collapsed(spark, d)).select(text_hash(F.col("key")).alias("key"), "n_docs", "n", F.col("path").alias("first_doc"), "start_line")


@query("SELECT p_partkey, p_name, members FROM (SELECT p_partkey, p_name, CAST(count(*) OVER (PARTITION BY p_name) AS BIGINT) AS members FROM part WHERE p_name IS NOT NULL) WHERE members > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    """A12"""
    return duplicates.duplicate_members(table(spark, d, "part").select("p_partkey", "p_name"), "p_name").select("p_partkey", "p_name", "members")


# ---- ownership and references


@query("""
SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS total, CAST(count(o) AS BIGINT) AS owned, CAST(count(*) - count(o) AS BIGINT) AS unowned, round(count(o) * 100.0 / count(*), 2) AS owned_percent
FROM (SELECT c_mktsegment, CASE WHEN c_acctbal > 0 THEN n_name END AS o FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey) GROUP BY c_mktsegment
""")
def ownership_coverage(spark: SparkSession, d: str) -> DataFrame:
    """A1, A2, A3, P16"""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return aggregates.coverage(rows, "c_mktsegment", F.when(F.col("c_acctbal") > 0, F.col("n_name")))


@query("""
SELECT owner_source, effective_owner, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN p.owner IS NOT NULL THEN 'declared' WHEN q.n = 1 THEN 'inherited' ELSE 'unowned' END AS owner_source, CASE WHEN p.owner IS NOT NULL THEN p.owner WHEN q.n = 1 THEN q.m END AS effective_owner
  FROM (SELECT p_partkey AS id, p_name AS parent, CASE WHEN p_size > 25 THEN p_brand END AS owner FROM part) p
  LEFT JOIN (SELECT p_name AS parent, count(*) AS n, min(p_type) AS m FROM part WHERE p_size <= 10 GROUP BY p_name) q USING (parent)
) GROUP BY owner_source, effective_owner
""")
def ownership_inheritance(spark: SparkSession, d: str) -> DataFrame:
    """J4, J5, H8"""
    part = table(spark, d, "part")
    assets = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("parent"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("owner"))
    parents = part.where("p_size <= 10").select(F.col("p_name").alias("parent"), F.col("p_type").alias("parent_owner"))
    return joins.effective_owner(assets, parents).groupBy("owner_source", "effective_owner").agg(F.count("*").alias("n"))


@query("""
WITH t AS (SELECT p_partkey AS id, p_name AS ref FROM part WHERE p_size <= 5 UNION SELECT p_partkey, p_brand || '/' || p_type FROM part WHERE p_size <= 5
), f AS (SELECT ref, count(*) AS n, min(id) AS m FROM t GROUP BY ref
), r AS (SELECT DISTINCT p_name AS ref FROM part UNION SELECT DISTINCT p_brand || '/' || p_type FROM part)
SELECT ref, CAST(coalesce(n, 0) AS BIGINT) AS candidates, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS state, CASE WHEN n = 1 THEN m ELSE -1 END AS only FROM r LEFT JOIN f USING (ref)
""")
def unique_match_resolution(spark: SparkSession, d: str) -> DataFrame:
    """J1, J2, J3"""
    part = table(spark, d, "part").withColumn("kind", F.concat("p_brand", F.lit("/"), "p_type"))
    refs = part.select(F.col("p_name").alias("ref")).union(part.select("kind")).distinct()
    targets = part.where("p_size <= 5").select(F.col("p_partkey").alias("id"), "p_name", "kind")
    return joins.resolve_references(refs, targets, ["p_name", "kind"]).select("ref", "candidates", "state", F.coalesce("only", F.lit(-1)).alias("only"))


@query("SELECT l_suppkey, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY l_suppkey")
def unknown_references(spark: SparkSession, d: str) -> DataFrame:
    """J6"""
    known = table(spark, d, "part").where("p_size > 10")
    lines = table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    return joins.unknown_references(lines, known, "l_partkey", "p_partkey").groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("""
SELECT status, inactive, usable, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT status, coalesce(status IN ('suspended', 'deprecated', 'archived'), FALSE) AS inactive, coalesce(status NOT IN ('suspended', 'deprecated', 'archived'), TRUE) AS usable
  FROM lineitem JOIN (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'archived' WHEN o_orderpriority = '1-URGENT' THEN 'deprecated' WHEN o_orderstatus = 'O' THEN 'stable' END AS status FROM orders) ON l_orderkey = o_orderkey
) GROUP BY status, inactive, usable
""")
def inactive_references(spark: SparkSession, d: str) -> DataFrame:
    """J7, P6"""
    status = F.when(F.col("o_orderstatus") == "F", "archived").when(F.col("o_orderpriority") == "1-URGENT", "deprecated").when(F.col("o_orderstatus") == "O", "stable")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), status.alias("status"))
    rows = table(spark, d, "lineitem").select("l_orderkey").join(orders, "l_orderkey")
    return rows.groupBy("status", is_inactive(F.col("status")).alias("inactive"), is_usable(F.col("status")).alias("usable")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '1997-01-01')")
def orphan_assets(spark: SparkSession, d: str) -> DataFrame:
    """J8"""
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_orderdate >= timestamp '1997-01-01'")
    return joins.orphans(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", urgent, "o_custkey")


@query("""
WITH m AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)
SELECT x.l_partkey AS a, y.l_partkey AS b, CAST(count(*) AS BIGINT) AS n FROM m x JOIN m y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY 1, 2
""")
def conflict_pairs(spark: SparkSession, d: str) -> DataFrame:
    """J9"""
    return joins.conflict_pairs(table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 40"), "l_orderkey", "l_partkey")


@query(r"""
SELECT page_id, host, CASE WHEN host IS NULL THEN FALSE ELSE coalesce(host = 'example.com' OR host LIKE '%.example.com' OR (host = 'm.ththth.example.net' AND (path = '/en' OR path LIKE '/en/%')), FALSE) END AS allowed FROM (
  SELECT page_id, nullif(lower(regexp_extract(url, '^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host, coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1), ''), '/') AS path FROM pages)
""")
def destination_allowlist(spark: SparkSession, d: str) -> DataFrame:
    """F14, J11"""
    pages = table(spark, d, "pages").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return pages.select("page_id", "host", joins.destination_allowed(F.col("host"), F.col("path"), ["example.com", "m.ththth.example.net/en"]).alias("allowed"))


# ---- time and order


@query(f"""
SELECT status, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN CAST(o_orderdate AS DATE) + 1500 < DATE '{TODAY}' THEN 'expired' WHEN CAST(o_orderdate AS DATE) + CAST(30 * (1 + o_orderkey % 24) AS INTEGER) < DATE '{TODAY}' THEN 'overdue' ELSE 'fresh' END AS status FROM orders
) GROUP BY status
""")
def freshness_status(spark: SparkSession, d: str) -> DataFrame:
    """P8"""
    day = F.to_date("o_orderdate")
    status = freshness(day, (30 * (1 + F.col("o_orderkey") % 24)).cast("int"), F.date_add(day, 1500), F.lit(TODAY).cast("date"))
    return table(spark, d, "orders").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS INTEGER) AS ordinal FROM events")
def occurrence_ordinal(spark: SparkSession, d: str) -> DataFrame:
    """W1"""
    return windows.occurrence_ordinal(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "ordinal")


@query(r"""
WITH h AS (SELECT page_id, list_transform(regexp_extract_all(html, '<h([1-6])[ >]', 1), lambda x: CAST(x AS INTEGER)) AS d FROM pages
), e AS (SELECT page_id, d, unnest(range(1, len(d) + 1)) AS ord FROM h)
SELECT page_id, CAST(ord AS INTEGER) AS ord, d[ord] AS depth, CAST(list_min(list_filter(range(ord + 1, len(d) + 1), lambda j: d[j] <= d[ord])) AS INTEGER) AS next_ord FROM e
""")
def section_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """W2, F20"""
    depths = F.transform(F.regexp_extract_all("html", F.lit("<h([1-6])[ >]"), F.lit(1)), lambda x, i: F.struct((i + 1).alias("ord"), x.cast("int").alias("depth")))
    rows = table(spark, d, "pages").select("page_id", F.explode(windows.next_boundary(depths)).alias("h"))
    return rows.select("page_id", "h.ord", "h.depth", "h.next_ord")


@query("""
SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 3
""")
def heaviest_sections(spark: SparkSession, d: str) -> DataFrame:
    """T5, T6"""
    return windows.top_per_group(table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.asc("doc_id")], 3)


@query("SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def first_match(spark: SparkSession, d: str) -> DataFrame:
    """W3, U2"""
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return windows.first_match(rows, ["user_id"], [F.asc("ts"), F.asc("event_id")]).select("user_id", "event_id", "event_type")


# ---- graph

EDGES_SQL = """
e AS (
  SELECT DISTINCT src, dst, req FROM (
    SELECT p_partkey AS src, p_partkey // 3 AS dst, p_size % 2 = 0 AS req FROM part UNION ALL SELECT p_partkey, p_partkey // 5, FALSE FROM part WHERE p_size % 4 = 0
  ) WHERE dst <> src AND dst IN (SELECT p_partkey FROM part)
)"""


def part_edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, required): every part names the part of a third of its key, some also that of a fifth."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("src"), "p_size")
    third = part.select("src", F.floor(F.col("src") / 3).cast("long").alias("dst"), (F.col("p_size") % 2 == 0).alias("required"))
    fifth = part.where("p_size % 4 = 0").select("src", F.floor(F.col("src") / 5).cast("long").alias("dst"), F.lit(False).alias("required"))
    known = part.select(F.col("src").alias("dst"))
    return third.unionByName(fifth).where("dst <> src").join(known, "dst", "left_semi").select("src", "dst", "required").distinct()


def _closure_sql(a: str, b: str) -> str:
    return f"""
WITH RECURSIVE {EDGES_SQL}, roots AS (SELECT DISTINCT {a} AS root FROM e
), reach(root, node, req) AS (SELECT root, root, TRUE FROM roots UNION SELECT r.root, e.{b}, r.req AND e.req FROM reach r JOIN e ON r.node = e.{a})
SELECT root, node, CASE WHEN bool_or(req) THEN 'required' ELSE 'optional' END AS membership FROM reach WHERE node <> root GROUP BY root, node
"""


@query(_closure_sql("src", "dst"))
def composition_closure(spark: SparkSession, d: str) -> DataFrame:
    """G1, G17"""
    edges = part_edges(spark, d)
    roots = edges.select(F.col("src").alias("root")).distinct()
    return graph.composition_closure(edges, roots)


@query(_closure_sql("dst", "src"))
def impact_closure(spark: SparkSession, d: str) -> DataFrame:
    """G2"""
    edges = part_edges(spark, d)
    focus = edges.select(F.col("dst").alias("root")).distinct()
    return graph.impact_closure(edges, focus)


@query(f"""
WITH RECURSIVE {EDGES_SQL}, s AS (SELECT DISTINCT src AS source FROM e
), reach(source, node, depth) AS (SELECT source, source, 0 FROM s UNION SELECT r.source, e.dst, r.depth + 1 FROM reach r JOIN e ON r.node = e.src)
SELECT source, node, CAST(min(depth) AS INTEGER) AS depth FROM reach GROUP BY source, node
""")
def multi_source_reachability(spark: SparkSession, d: str) -> DataFrame:
    """G8"""
    edges = part_edges(spark, d)
    return graph.reachability(edges, edges.select(F.col("src").alias("source")).distinct())


@query(f"""
WITH RECURSIVE {EDGES_SQL}, c AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e WHERE src % 50 = 7
), reach(a, b) AS (SELECT src, dst FROM c UNION SELECT r.a, c.dst FROM reach r JOIN c ON r.b = c.src)
SELECT x.a AS node, least(min(x.b), x.a) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a
""")
def cycle_components(spark: SparkSession, d: str) -> DataFrame:
    """The edges of some parts also lead back"""
    edges = part_edges(spark, d)
    back = edges.where("src % 50 = 7").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "required")
    return graph.cycle_members(edges.unionByName(back))


@query(f"""
WITH {EDGES_SQL} SELECT p_partkey AS node, CASE WHEN p_partkey IN (SELECT dst FROM e) THEN 'inner' WHEN p_partkey IN (SELECT src FROM e) THEN 'root' ELSE 'standalone' END AS shape FROM part
""")
def structural_roots(spark: SparkSession, d: str) -> DataFrame:
    """G6"""
    return graph.structural_roots(table(spark, d, "part").select(F.col("p_partkey").alias("node")), part_edges(spark, d))


# ---- snapshots, sets, policies, gates


@query("""
WITH a AS (SELECT * FROM orders WHERE o_orderkey % 10 <> 0
), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 13 <> 0)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change,
  CASE WHEN a.o_orderkey IS NULL OR b.o_orderkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.o_orderpriority IS DISTINCT FROM b.o_orderpriority THEN 'o_orderpriority' END, CASE WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'o_orderstatus' END) END AS fields
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.o_orderpriority IS DISTINCT FROM b.o_orderpriority
""")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """D1, J15, U3"""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    old = orders.where("o_orderkey % 10 <> 0")
    status = F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))
    new = orders.where("o_orderkey % 13 <> 0").select("o_orderkey", status.alias("o_orderstatus"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    return diff.keyed_diff(old, new, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("""
SELECT key, CASE WHEN bool_or(s = 1) AND bool_or(s = 2) THEN 'shared' WHEN bool_or(s = 2) THEN 'added' ELSE 'removed' END AS change FROM (
  SELECT l_partkey AS key, 1 AS s FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-01-01' AND l_quantity > 45 UNION ALL SELECT l_partkey, 2 FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_quantity > 45
) GROUP BY key
""")
def set_changes(spark: SparkSession, d: str) -> DataFrame:
    """U3, U4, U6"""
    lines = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("key"), "l_shipdate")
    return sets.added_removed_shared(lines.where("l_shipdate < timestamp '1995-01-01'"), lines.where("l_shipdate >= timestamp '1998-01-01'"), "key")


@query("""
SELECT event_type, CAST(count(*) FILTER (event_id % 3 = 0) AS BIGINT) AS n_from, CAST(count(*) FILTER (event_id % 3 <> 0) AS BIGINT) AS n_to, CAST(count(*) FILTER (event_id % 3 <> 0) - count(*) FILTER (event_id % 3 = 0) AS BIGINT) AS delta
FROM events GROUP BY event_type HAVING count(*) FILTER (event_id % 3 <> 0) <> count(*) FILTER (event_id % 3 = 0)
""")
def count_delta(spark: SparkSession, d: str) -> DataFrame:
    """A15"""
    e = table(spark, d, "events").select("event_id", "event_type")
    return aggregates.count_delta(e.where("event_id % 3 = 0"), e.where("event_id % 3 <> 0"), "event_type")


@query("""
WITH a AS (SELECT DISTINCT c_nationkey, c_mktsegment AS v FROM customer WHERE c_acctbal > 7000
), b AS (SELECT DISTINCT c_nationkey, c_mktsegment AS v FROM customer WHERE c_acctbal BETWEEN 4000 AND 7000)
SELECT c_nationkey, 'added' AS change, v AS value FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT c_nationkey, 'removed', v FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
""")
def policy_transitions(spark: SparkSession, d: str) -> DataFrame:
    """U5, D6, D9"""
    c = table(spark, d, "customer")
    lists = lambda rows: rows.groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("v"))
    return diff.list_transitions(lists(c.where("c_acctbal > 7000")), lists(c.where("c_acctbal between 4000 and 7000")), "c_nationkey", "v")


@query("""
SELECT c_custkey, coalesce(local, profile, repository) AS network_allowed, CASE WHEN c_custkey % 5 = 0 THEN CASE WHEN coalesce(profile, repository) = FALSE THEN FALSE END ELSE coalesce(local, profile, repository) END AS closed FROM (
  SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN FALSE WHEN c_acctbal > 8000 THEN TRUE END AS local, CASE WHEN n_nationkey % 4 = 0 THEN FALSE WHEN n_nationkey % 4 = 1 THEN TRUE END AS profile, CASE WHEN n_regionkey = 0 THEN FALSE WHEN n_regionkey = 1 THEN TRUE END AS repository
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
""")
def effective_policy(spark: SparkSession, d: str) -> DataFrame:
    """R1"""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    local = F.when(F.col("c_acctbal") < 0, F.lit(False)).when(F.col("c_acctbal") > 8000, F.lit(True))
    profile = F.when(F.col("n_nationkey") % 4 == 0, F.lit(False)).when(F.col("n_nationkey") % 4 == 1, F.lit(True))
    repository = F.when(F.col("n_regionkey") == 0, F.lit(False)).when(F.col("n_regionkey") == 1, F.lit(True))
    inherited = policy.nearest(profile, repository)
    return rows.select("c_custkey", policy.nearest(local, profile, repository).alias("network_allowed"), policy.fail_closed(local, F.col("c_custkey") % 5 != 0, inherited).alias("closed"))


@query("""
WITH RECURSIVE p AS (SELECT n_name AS name, CASE WHEN n_nationkey % 6 = 0 THEN NULL WHEN n_nationkey = 23 THEN 'NOWHERE' ELSE 'NATION_' || (n_nationkey - 1) END AS parent FROM nation
), up(name, above, chain) AS (SELECT name, parent, [name] FROM p UNION ALL SELECT up.name, p.parent, list_prepend(p.name, up.chain) FROM up JOIN p ON up.above = p.name
), last AS (SELECT name, max(len(chain)) AS n FROM up GROUP BY name)
SELECT up.name, CASE WHEN above IS NULL THEN array_to_string(chain, '>') ELSE '' END AS chain, CASE WHEN above IS NULL THEN 'complete' ELSE 'missing' END AS state FROM up JOIN last ON up.name = last.name AND len(up.chain) = last.n
""")
def profile_chains(spark: SparkSession, d: str) -> DataFrame:
    """G10"""
    n = F.col("n_nationkey")
    parent = F.when(n % 6 == 0, F.lit(None)).when(n == 23, F.lit("NOWHERE")).otherwise(F.concat(F.lit("NATION_"), (n - 1).cast("string")))
    chains = policy.profile_chain(table(spark, d, "nation").select(F.col("n_name").alias("name"), parent.alias("parent")))
    return chains.select("name", F.array_join("chain", ">").alias("chain"), "state")


READINESS_SQL = """
SELECT n_nationkey, CAST(count(c_custkey) AS BIGINT) AS total, CAST(count(c_custkey) FILTER (c_acctbal <= 0) AS BIGINT) AS unowned, CAST(count(c_custkey) FILTER (c_acctbal < -990) AS BIGINT) AS errors, CAST(count(c_custkey) FILTER (c_mktsegment = 'BUILDING' AND c_acctbal > 9900) AS BIGINT) AS unresolved
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey
"""
SCORE_SQL = f"""
SELECT *, CASE WHEN errors > 0 OR score < 70 THEN 'not_ready' WHEN score >= 90 THEN 'ready' ELSE 'needs_attention' END AS level FROM (
  SELECT *, CAST(greatest(0.0, 100 - CASE WHEN errors > 0 THEN 40 ELSE 0 END - CASE WHEN unresolved > 0 THEN 30 ELSE 0 END - CASE WHEN total > 0 THEN round(20.0 * unowned / total) ELSE 0 END - CASE WHEN total = 0 THEN 10 ELSE 0 END) AS INTEGER) AS score FROM ({READINESS_SQL}))
"""


def readiness_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    there = F.col("c_custkey").isNotNull()
    counts = rows.groupBy("n_nationkey").agg(F.count("c_custkey").alias("total"), F.count_if(there & (F.col("c_acctbal") <= 0)).alias("unowned"), F.count_if(there & (F.col("c_acctbal") < -990)).alias("errors"), F.count_if(there & (F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 9900)).alias("unresolved"))
    scored = counts.withColumn("score", aggregates.readiness(*(F.col(c) for c in ("total", "unowned", "errors", "unresolved"))))
    return scored.withColumn("level", aggregates.readiness_level(F.col("score"), F.col("errors") > 0))


@query(SCORE_SQL)
def readiness_score(spark: SparkSession, d: str) -> DataFrame:
    """A20, A4"""
    return readiness_rows(spark, d)


@query(f"""
SELECT n_regionkey, ['pass', 'warn', 'fail'][max(CASE WHEN m = 0 OR mode = 'off' THEN 0 WHEN mode = 'warn' THEN 1 ELSE 2 END) + 1] AS status FROM (
  SELECT n_regionkey, errors + unresolved AS m, CASE WHEN s.n_nationkey % 3 = 2 OR n_regionkey = 4 THEN 'fail' WHEN s.n_nationkey % 3 = 1 OR n_regionkey % 2 = 1 THEN 'warn' ELSE 'off' END AS mode FROM ({SCORE_SQL}) s JOIN nation n ON s.n_nationkey = n.n_nationkey
) GROUP BY n_regionkey
""")
def gate_status(spark: SparkSession, d: str) -> DataFrame:
    """A21, A22"""
    rows = readiness_rows(spark, d).join(table(spark, d, "nation").select("n_nationkey", "n_regionkey"), "n_nationkey")
    first = F.element_at(F.array(F.lit("off"), F.lit("warn"), F.lit("fail")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    second = F.when(F.col("n_regionkey") == 4, "fail").when(F.col("n_regionkey") % 2 == 1, "warn").otherwise("off")
    rows = rows.withColumn("status", diff.gate(F.col("errors") + F.col("unresolved"), aggregates.stricter(first, second)))
    return aggregates.worst_status(rows, ["n_regionkey"])


@query("""
SELECT t.kind, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT unnest(['asset', 'owner', 'policy', 'finding', 'owned_by', 'references', 'inherits']) AS kind) t LEFT JOIN (
  SELECT 'asset' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'owner', count(*) FROM nation UNION ALL SELECT 'owned_by', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'references', count(*) FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)
) c USING (kind)
""")
def trust_graph_summary(spark: SparkSession, d: str) -> DataFrame:
    """A8"""
    customer, nation = table(spark, d, "customer"), table(spark, d, "nation")
    named = lambda rows, kind: rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    parts = [named(customer, "asset"), named(nation, "owner"), named(customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")), "owned_by"), named(table(spark, d, "orders").select("o_custkey", "o_orderpriority").distinct(), "references")]
    return aggregates.zero_filled(sets.union_all(parts), "kind", ["asset", "owner", "policy", "finding", "owned_by", "references", "inherits"])


@query("""
SELECT p_partkey, sha256('{"p_brand":' || coalesce('"' || p_brand || '"', 'null') || ',"p_name":' || coalesce('"' || p_name || '"', 'null') || ',"p_partkey":' || p_partkey || ',"p_size":' || coalesce(CAST(p_size AS VARCHAR), 'null') || '}') AS fingerprint FROM part
""")
def canonical_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """K5, F24, R3"""
    part = table(spark, d, "part")
    return part.select("p_partkey", fingerprint(part, ["p_size", "p_name", "p_partkey", "p_brand"]).alias("fingerprint"))


@query(f"""
SELECT source, CAST(count(*) AS BIGINT) AS n_findings, CAST(count(DISTINCT rule_id) AS BIGINT) AS n_rules, ['low', 'medium', 'high', 'critical'][max({RANK_SQL}) + 1] AS max_severity, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules
FROM (SELECT split_part(path, '/', 1) AS source, * FROM ({FINDINGS_SQL})) GROUP BY source
""")
def review_bundles(spark: SparkSession, d: str) -> DataFrame:
    """A16, P7"""
    from .functions.predicates import SEVERITIES, name_at

    rows = posture.line_findings(table(spark, d, "documents")).withColumn("source", F.split_part("path", F.lit("/"), F.lit(1)))
    worst = name_at(F.max(rank_of(F.col("severity"), SEVERITIES)), SEVERITIES)
    return rows.groupBy("source").agg(F.count("*").alias("n_findings"), F.count_distinct("rule_id").alias("n_rules"), worst.alias("max_severity"), F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules"))


from . import diff_queries, graph_queries, inventory_queries, security_queries  # noqa: E402, F401  register more queries
