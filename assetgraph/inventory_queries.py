"""More registered queries: inventories, classification, rendered views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.commands import helper_script, name_problem, script_share, selector_kind
from .functions.paths import classify_path
from .functions.text import path_of
from .operators import diff, duplicates, graph, inventory
from .plans.posture import line_findings
from .queries import EDGES_SQL, FINDINGS_SQL, LINES_SQL, part_edges, query, table

PATH_SQL = "coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1), ''), '/')"


@query(f"""
SELECT kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN regexp_matches(p, '^/en/[0-9]+$') THEN 'english_item' WHEN regexp_matches(p, '^/(fr|de|es)/[0-9]+$') THEN 'other_item' WHEN regexp_matches(p, '^/[a-z][a-z]/?$') THEN 'language_root' ELSE 'unknown' END AS kind FROM (SELECT {PATH_SQL} AS p FROM pages)) GROUP BY kind
""")
def path_classification(spark: SparkSession, d: str) -> DataFrame:
    """The first rule that fits"""
    p = path_of(F.col("url"))
    kind = F.when(p.rlike("^/en/[0-9]+$"), "english_item").when(p.rlike("^/(fr|de|es)/[0-9]+$"), "other_item").when(p.rlike("^/[a-z][a-z]/?$"), "language_root").otherwise("unknown")
    return table(spark, d, "pages").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


SELECTOR = {0: "1.2.3", 1: "^1.2", 2: "latest", 3: ">=1.0,<2", 4: "1.x", 5: "==2.0.1", 6: "git+ssh", 7: ""}


@query(f"""
SELECT p_partkey, CASE p_partkey % 9 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in SELECTOR.items())} END AS selector, CASE p_partkey % 9 WHEN 0 THEN 'exact' WHEN 1 THEN 'range' WHEN 2 THEN 'floating' WHEN 3 THEN 'range' WHEN 4 THEN 'floating' WHEN 5 THEN 'exact' WHEN 7 THEN 'floating' ELSE 'unknown' END AS kind FROM part
""")
def version_selectors(spark: SparkSession, d: str) -> DataFrame:
    """F13"""
    s = F.create_map(*(F.lit(x) for kv in SELECTOR.items() for x in kv))[(F.col("p_partkey") % 9).cast("int")]
    rows = table(spark, d, "part").select("p_partkey", s.alias("selector"))
    return rows.select("p_partkey", "selector", selector_kind(F.col("selector")).alias("kind"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'tools/' || replace(p_name, ' ', '_') || '.py' WHEN p_size % 4 = 1 THEN 'run.sh' END AS script FROM part
""")
def helper_commands(spark: SparkSession, d: str) -> DataFrame:
    """F10"""
    file = F.concat(F.lit("tools/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".py"))
    command = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("python3 -u ./"), file, F.lit(" --all"))).when(F.col("p_size") % 4 == 1, "bash run.sh").when(F.col("p_size") % 4 == 2, "node ../up.js").otherwise("echo hello.txt")
    return table(spark, d, "part").select("p_partkey", helper_script(command).alias("script"))


@query("""
SELECT coalesce(problem, 'none') AS problem, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN v IS NULL OR trim(v) = '' THEN 'missing' WHEN length(trim(v)) > 64 THEN 'too_long' WHEN NOT regexp_matches(trim(v), '^[a-z0-9-]+$') THEN 'bad_characters' WHEN trim(v) LIKE '-%' OR trim(v) LIKE '%-' THEN 'edge_hyphen' WHEN trim(v) LIKE '%--%' THEN 'double_hyphen' END AS problem
  FROM (SELECT CASE p_size % 6 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '-') WHEN 2 THEN replace(p_name, ' ', '--') WHEN 3 THEN replace(p_name, ' ', '-') || '-' WHEN 4 THEN repeat('a', 70) END AS v FROM part)
) GROUP BY 1
""")
def name_validation(spark: SparkSession, d: str) -> DataFrame:
    """R8, A19"""
    size = F.col("p_size") % 6
    dash = F.replace("p_name", F.lit(" "), F.lit("-"))
    v = F.when(size == 0, F.col("p_name")).when(size == 1, dash).when(size == 2, F.replace("p_name", F.lit(" "), F.lit("--"))).when(size == 3, F.concat(dash, F.lit("-"))).when(size == 4, F.lit("a" * 70))
    return table(spark, d, "part").groupBy(F.coalesce(name_problem(v), F.lit("none")).alias("problem")).agg(F.count("*").alias("n"))


@query(r"SELECT script, lang, CAST(count(*) AS BIGINT) AS n FROM (SELECT lang, CASE WHEN l = 0 THEN 'none' WHEN a >= c AND a >= l - a - c THEN 'latin' WHEN c >= l - a - c THEN 'cjk' ELSE 'other' END AS script FROM (SELECT lang, len(regexp_extract_all(text, '\p{Latin}')) AS a, len(regexp_extract_all(text, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]')) AS c, len(regexp_extract_all(text, '\p{L}')) AS l FROM documents)) GROUP BY script, lang")
def body_scripts(spark: SparkSession, d: str) -> DataFrame:
    """F25"""
    return table(spark, d, "documents").groupBy(script_share(F.col("text")).alias("script"), "lang").agg(F.count("*").alias("n"))


@query("""
SELECT name, CASE WHEN p > 1 THEN 'ambiguous' WHEN p = 1 THEN 'resolved' WHEN o > 1 THEN 'ambiguous' WHEN o = 1 THEN s ELSE 'missing' END AS outcome
FROM (SELECT p_name AS name, count(*) FILTER (p_size <= 1) AS p, count(*) FILTER (p_size = 50) AS o, min(CASE WHEN p_size = 50 THEN 'oversize' END) AS s FROM part GROUP BY p_name)
""")
def candidate_states(spark: SparkSession, d: str) -> DataFrame:
    """J12, J13"""
    rows = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.count_if(F.col("p_size") <= 1).alias("p"), F.count_if(F.col("p_size") == 50).alias("o"))
    return rows.select("name", inventory.candidate_outcome(F.col("p"), F.col("o"), F.lit("oversize")).alias("outcome"))


@query("""
SELECT s_suppkey, CAST((SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS BIGINT) AS lines, CAST((SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R') AS BIGINT) AS returned, CAST((SELECT count(*) FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal > 9900) AS BIGINT) AS rich_customers FROM supplier
""")
def surface_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """J14, J16"""
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_returnflag")
    base = inventory.enrich(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey", {"lines": lines, "returned": lines.where("l_returnflag = 'R'")})
    rich = table(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("s_nationkey"))
    return inventory.enrich(base, "s_nationkey", {"rich_customers": rich}).select("s_suppkey", "lines", "returned", "rich_customers")


@query("""
SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(count(*) FILTER (n_chars > 5000) AS BIGINT) AS n_long, CAST(count(*) FILTER (n_chars < 100) AS BIGINT) AS n_short, CAST(count(*) FILTER (lang = 'en') AS BIGINT) AS n_en, CAST(count(*) FILTER (lang IS NULL) AS BIGINT) AS n_no_lang,
  CAST(count(DISTINCT source) AS BIGINT) AS n_sources, CAST(count(*) FILTER (text LIKE '%http%') AS BIGINT) AS n_links, CAST(count(*) FILTER (text LIKE '%@%') AS BIGINT) AS n_at, CAST(count(*) FILTER (n_chars <> length(text)) AS BIGINT) AS n_length_differs FROM documents
""")
def inventory_summary(spark: SparkSession, d: str) -> DataFrame:
    """Many conditional counts in one pass"""
    counts = {"n_long": F.col("n_chars") > 5000, "n_short": F.col("n_chars") < 100, "n_en": F.col("lang") == "en", "n_no_lang": F.col("lang").isNull(), "n_links": F.col("text").contains("http"), "n_at": F.col("text").contains("@"), "n_length_differs": F.col("n_chars") != F.length("text")}
    return table(spark, d, "documents").agg(F.count("*").alias("n_docs"), F.count_distinct("source").alias("n_sources"), *(F.count_if(c).alias(n) for n, c in counts.items()))


@query(rf"""
WITH l AS ({LINES_SQL}), s AS (SELECT doc_id, line, content, CASE WHEN lag(content) OVER w IS NULL OR lag(content) OVER w NOT LIKE '%,' THEN 1 ELSE 0 END AS s FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line)
), g AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY line) AS g FROM s)
SELECT doc_id, CAST(min(line) AS INTEGER) AS first_line, CAST(count(*) AS BIGINT) AS n_lines, sha256(string_agg(content, ' ' ORDER BY line)) AS text_hash FROM g GROUP BY doc_id, g
""")
def logical_lines(spark: SparkSession, d: str) -> DataFrame:
    """W5"""
    lines = duplicates.exploded_lines(table(spark, d, "documents"), "doc_id", "text")
    return inventory.logical_lines(lines, "doc_id", ",").select("doc_id", "first_line", "n_lines", F.sha2("text", 256).alias("text_hash"))


@query(r"SELECT doc_id, sha256(array_to_string(string_split_regex(text, '\r\n|\n|\r')[2:4], chr(10))) AS slice_hash FROM documents")
def inspect_slice(spark: SparkSession, d: str) -> DataFrame:
    """P19"""
    return table(spark, d, "documents").select("doc_id", F.sha2(inventory.line_slice(F.col("text"), 2, 4), 256).alias("slice_hash"))


@query("""
SELECT c_custkey, field FROM (SELECT c_custkey, unnest([CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'segment' END, CASE WHEN c_acctbal < 0 THEN 'owner' END]) AS field FROM customer) WHERE field IS NOT NULL
""")
def required_metadata(spark: SparkSession, d: str) -> DataFrame:
    """R7"""
    rows = table(spark, d, "customer").select("c_custkey", F.when(~F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_acctbal") >= 0, F.col("c_name")).otherwise(" ").alias("owner"))
    return inventory.missing_fields(rows, "c_custkey", ["segment", "owner"])


@query(f"""WITH {EDGES_SQL} SELECT src, string_agg('  n' || src || CASE WHEN req THEN ' --> n' ELSE ' -.-> n' END || dst, chr(10) ORDER BY dst, CASE WHEN req THEN ' --> n' ELSE ' -.-> n' END) AS text FROM e GROUP BY src""")
def graph_text(spark: SparkSession, d: str) -> DataFrame:
    """K4"""
    return inventory.mermaid_edges(part_edges(spark, d))


@query(f"""
WITH {EDGES_SQL} SELECT a.p_brand AS "from", b.p_brand AS "to", CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT src, dst FROM e) JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_brand <> b.p_brand GROUP BY 1, 2
""")
def graph_summary_view(spark: SparkSession, d: str) -> DataFrame:
    """P18, U6"""
    return inventory.grouped_view(part_edges(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("group")))


@query(f"WITH {EDGES_SQL}, f AS (SELECT min(src) AS f FROM e) SELECT DISTINCT src, dst FROM e, f WHERE src = f OR dst = f")
def graph_focus(spark: SparkSession, d: str) -> DataFrame:
    """P17"""
    edges = part_edges(spark, d)
    focus = edges.agg(F.min("src").alias("focus"))  # one row
    return graph.focus_edges(edges.join(F.broadcast(focus), F.col("focus").isNotNull()), F.col("focus")).select("src", "dst").distinct()


@query(f"""
WITH f AS ({FINDINGS_SQL}), a AS (SELECT DISTINCT doc_id || ':' || rule_id || ':' || line AS k FROM f WHERE doc_id % 3 <> 0), b AS (SELECT DISTINCT doc_id || ':' || rule_id || ':' || line AS k FROM f WHERE doc_id % 4 <> 0)
SELECT k, 'added' AS change, '' AS fields FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT k, 'removed', '' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
""")
def finding_diff(spark: SparkSession, d: str) -> DataFrame:
    """D3"""
    k = F.concat_ws(":", F.col("doc_id").cast("string"), "rule_id", F.col("line").cast("string")).alias("k")
    rows = line_findings(table(spark, d, "documents"))
    return diff.keyed_diff(rows.where("doc_id % 3 <> 0").select(k).distinct(), rows.where("doc_id % 4 <> 0").select(k).distinct(), "k", [])


@query("""
SELECT n_nationkey, field FROM (
  SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN FALSE WHEN n_nationkey % 3 = 1 THEN TRUE END AS old_net, CASE WHEN n_regionkey % 3 = 0 THEN TRUE WHEN n_regionkey % 3 = 1 THEN FALSE END AS new_net,
    CASE WHEN n_nationkey % 4 < 2 THEN TRUE WHEN n_nationkey % 4 = 2 THEN FALSE END AS old_app, CASE WHEN n_regionkey % 2 = 0 THEN TRUE END AS new_app FROM nation
), (SELECT unnest(['network_allowed', 'requires_approval']) AS field)
WHERE CASE field WHEN 'network_allowed' THEN old_net IS NOT DISTINCT FROM FALSE AND new_net IS DISTINCT FROM FALSE ELSE old_app IS NOT DISTINCT FROM TRUE AND new_app IS DISTINCT FROM TRUE END
""")
def policy_relaxations(spark: SparkSession, d: str) -> DataFrame:
    """Approvals no longer asked for, permissions no longer denied"""
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    false, true = F.lit(False), F.lit(True)
    net = diff.is_relaxation("network_allowed", F.when(n % 3 == 0, false).when(n % 3 == 1, true), F.when(r % 3 == 0, true).when(r % 3 == 1, false))
    app = diff.is_relaxation("requires_approval", F.when(n % 4 < 2, true).when(n % 4 == 2, false), F.when(r % 2 == 0, true))
    fields = F.array_compact(F.array(F.when(net, F.lit("network_allowed")), F.when(app, F.lit("requires_approval"))))
    return table(spark, d, "nation").select("n_nationkey", F.explode(fields).alias("field"))


@query(f"""
WITH f AS ({FINDINGS_SQL})
SELECT 'all' AS rule, CAST(count(*) AS BIGINT) AS n FROM f UNION ALL SELECT 'by_id_and_document', count(*) FROM (SELECT DISTINCT rule_id, doc_id FROM f) UNION ALL SELECT 'by_id', count(DISTINCT rule_id) FROM f
""")
def distinct_rules(spark: SparkSession, d: str) -> DataFrame:
    """One set of findings under three rules of identity"""
    f = line_findings(table(spark, d, "documents"))
    counts = f.agg(F.count("*").alias("all"), F.count_distinct("rule_id", "doc_id").alias("by_id_and_document"), F.count_distinct("rule_id").alias("by_id"))
    return counts.unpivot([], ["all", "by_id_and_document", "by_id"], "rule", "n")


@query("""
SELECT reason, CAST(count(*) AS BIGINT) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM (
  SELECT n_chars, CASE WHEN source IN ('src3', 'src7') THEN 'excluded' WHEN n_chars > 20000 THEN 'oversize' WHEN text IS NULL OR text = '' THEN 'empty' ELSE 'parsed' END AS reason FROM documents
) GROUP BY reason
""")
def inspection_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The state of every document, none dropped silently"""
    state = F.when(F.col("source").isin("src3", "src7"), "excluded").when(F.col("n_chars") > 20000, "oversize").when(F.coalesce(F.col("text"), F.lit("")) == "", "empty").otherwise("parsed")
    return table(spark, d, "documents").groupBy(state.alias("reason")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(f"""
SELECT gate, n, CASE WHEN n = 0 THEN 'pass' ELSE mode END AS outcome FROM (
  SELECT 'critical_findings' AS gate, CAST(count(*) FILTER (severity = 'critical') AS BIGINT) AS n, 'fail' AS mode FROM ({FINDINGS_SQL}) UNION ALL SELECT 'hidden_characters', CAST(count(*) FILTER (rule_id LIKE 'hidden%') AS BIGINT), 'fail' FROM ({FINDINGS_SQL}) UNION ALL SELECT 'low_findings', CAST(count(*) FILTER (severity = 'low') AS BIGINT), 'warn' FROM ({FINDINGS_SQL}))
""")
def strict_gates(spark: SparkSession, d: str) -> DataFrame:
    """A24, D10, K7"""
    f = line_findings(table(spark, d, "documents"))
    counts = f.agg(F.count_if(F.col("severity") == "critical").alias("critical_findings"), F.count_if(F.col("rule_id").startswith("hidden")).alias("hidden_characters"), F.count_if(F.col("severity") == "low").alias("low_findings"))
    rows = counts.unpivot([], counts.columns, "gate", "n")
    return rows.select("gate", "n", diff.gate(F.col("n"), F.when(F.col("gate") == "low_findings", "warn").otherwise("fail")).alias("outcome"))


@query("""
SELECT p_brand, p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE p_type WHEN 'PROMO' THEN 0 WHEN 'ECONOMY' THEN 1 WHEN 'STANDARD' THEN 2 ELSE 9 END, p_partkey) AS r FROM part) WHERE r <= 2
""")
def ranked_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The first two of each brand in the order of kinds"""
    from .functions.predicates import rank_of
    from .operators import windows

    rank = F.coalesce(rank_of(F.col("p_type"), ("PROMO", "ECONOMY", "STANDARD")), F.lit(9))
    return windows.top_per_group(table(spark, d, "part").select("p_brand", "p_type", "p_partkey"), ["p_brand"], [rank.asc(), F.asc("p_partkey")], 2)


# Paths made of parts, by key: roots, support folders at each depth, escapes and lookalikes.
PATHS = (
    "concat('skills/', a, '/SKILL.md')", "concat('.agents\\\\skills/', a, '/./', b, '//SKILL.md')", "concat('skills/', a, '/references/', b, '.md')", "concat('.agents/skills/', a, '/', b, '/scripts/run.sh')",
    "concat('skills/profiles/', a, '.md')", "concat('skills/scripts/', a)", "concat('skills/', a, '/tools/', b)", "concat('skills/', a, '/', b, '.md')", "concat('skills/SKILL.md')", "concat('contexts/', a, '/references/', b)",
    "concat('context/', a)", "concat('lenses/', a, '.md')", "'AGENTS.md'", "concat('.agents/', a, '.md')", "concat('tools/', a, '/assetgraph.config.json')", "concat(a, '/assetgraph.config.jsonc')",
    "concat('docs/', a, '/profiles/', b, '/examples/x.md')", "concat('docs/examples/', a)", "concat('examples/', a)", "concat('../', a)", "concat('/skills/', a, '/SKILL.md')", "concat('C:/', a)", "concat('skills/', a, '/assets/references/', b)", "'./'",
)
_PATH_ROWS = f"SELECT p_partkey, CASE p_partkey % {len(PATHS)} {' '.join(f'WHEN {i} THEN {p}' for i, p in enumerate(PATHS))} END AS path, p_size FROM (SELECT p_partkey, p_size, replace(p_name, ' ', '-') AS a, lower(p_brand) AS b FROM part)"
_RESERVED = "(assets|examples|profiles|references|scripts)"


@query(rf"""
WITH r AS ({_PATH_ROWS.replace(chr(92) * 2, chr(92))}
), n AS (SELECT p_partkey, p_size, path, replace(path, '\', '/') AS q FROM r
), p AS (SELECT p_partkey, p_size, CASE WHEN starts_with(q, '/') OR regexp_matches(q, '^[A-Za-z]:/') OR list_contains(string_split(q, '/'), '..') THEN NULL ELSE nullif(array_to_string(list_filter(string_split(q, '/'), lambda s: s NOT IN ('', '.')), '/'), '') END AS p FROM n
), l AS (SELECT *, nullif(regexp_extract(p, '^(\.agents/skills|skills)(/|$)', 1), '') AS root, regexp_replace(p, '^(\.agents/skills|skills)/?', '') AS local FROM p
), a AS (SELECT *, regexp_extract('/' || local || '/', '^(.*?)/{_RESERVED}/', 1) AS before, nullif(regexp_extract('/' || local || '/', '^.*?/{_RESERVED}/', 1), '') AS folder FROM l)
SELECT p_partkey, kind, CASE WHEN p IS NULL THEN 'unknown' ELSE scope END AS scope, rule FROM (SELECT *, CASE
  WHEN p IS NULL THEN 'unknown' WHEN root IS NOT NULL AND folder IS NULL AND regexp_matches(local, '^.+/SKILL\.md$') THEN 'skill-entrypoint' WHEN root IS NOT NULL AND folder IS NOT NULL AND before <> '' THEN 'skill-local-support'
  WHEN root IS NOT NULL AND folder IN ('profiles', 'references', 'examples') THEN 'generic-' || folder[1 : -2] WHEN root IS NOT NULL AND (folder IS NOT NULL OR list_contains(string_split(local, '/'), 'tools')) THEN 'unknown'
  WHEN regexp_matches(p, '^context(/|$)') THEN 'unknown' WHEN regexp_matches(p, '^contexts(/|$)') THEN 'context-root' WHEN regexp_matches(p, '^lenses(/|$)') THEN 'lens-root' WHEN p = 'AGENTS.md' OR regexp_matches(p, '^\.agents(/|$)') THEN 'agent-root'
  WHEN regexp_matches(p, '^tools(/|$)') THEN 'repository-tool' WHEN regexp_matches(p, '(^|/)assetgraph\.config\.jsonc?$') THEN 'config-file' WHEN regexp_matches(p, '^[^/]+/(.*/)?profiles/') THEN 'generic-profile'
  WHEN regexp_matches(p, '^[^/]+/(.*/)?references/') THEN 'generic-reference' WHEN regexp_matches(p, '^[^/]+/(.*/)?examples/') THEN 'generic-example' ELSE 'unknown' END AS rule,
  CASE rule WHEN 'skill-entrypoint' THEN 'skill' WHEN 'skill-local-support' THEN folder[1 : -2] WHEN 'context-root' THEN CASE WHEN p_size % 3 = 0 THEN 'context_lens' ELSE 'context' END WHEN 'lens-root' THEN 'context_lens' WHEN 'agent-root' THEN 'agent' WHEN 'config-file' THEN 'config' WHEN 'generic-profile' THEN 'profile' WHEN 'generic-reference' THEN 'reference' WHEN 'generic-example' THEN 'example' ELSE 'unknown' END AS kind,
  CASE WHEN rule IN ('skill-entrypoint', 'context-root', 'lens-root', 'agent-root') THEN 'independent' WHEN rule = 'skill-local-support' THEN 'skill-local' WHEN rule IN ('repository-tool', 'config-file') OR (root IS NOT NULL AND folder IS NULL AND list_contains(string_split(local, '/'), 'tools')) THEN 'repository-support' ELSE 'unknown' END AS scope FROM a)
""")
def asset_path_rules(spark: SparkSession, d: str) -> DataFrame:
    """The kind, scope and rule of each path"""
    rows = spark.sql(_PATH_ROWS.replace("FROM part)", "FROM {part})"), part=table(spark, d, "part"))
    kind = F.when(F.col("p_size") % 3 == 0, "context_lens")
    return rows.select("p_partkey", classify_path(F.col("path"), kind).alias("c")).select("p_partkey", "c.kind", "c.scope", "c.rule")
