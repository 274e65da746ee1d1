"""Registered queries of graphs with evidence and source sets, the executable graph, and scan boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import path_of
from .operators import boundaries, reach, repeats
from .queries import EDGES_SQL, part_edges, query, table

_OWNERS = "p_size % 10 = 0"


@query(f"""
WITH RECURSIVE {EDGES_SQL}, f AS (SELECT e.src, e.dst, CAST(p_size % 17 AS INTEGER) AS line, p_name AS raw FROM e JOIN part ON p_partkey = e.src
), o AS (SELECT p_partkey AS owner FROM part WHERE {_OWNERS}
), r(owner, node, depth) AS (SELECT owner, owner, 0 FROM o UNION SELECT r.owner, f.dst, r.depth + 1 FROM r JOIN f ON r.node = f.src
), d AS (SELECT owner, node, min(depth) AS depth FROM r GROUP BY owner, node
), c AS (SELECT d.owner, f.dst AS node, d.depth + 1 AS depth, f.src, f.line, f.raw, row_number() OVER (PARTITION BY d.owner, f.dst ORDER BY d.depth, encode(CAST(f.src AS VARCHAR)), f.line, encode(f.raw)) AS n FROM d JOIN f ON d.node = f.src)
SELECT owner, node, CAST(depth AS INTEGER) AS depth, src AS source, line, raw FROM c WHERE n = 1
""")
def reference_evidence(spark: SparkSession, d: str) -> DataFrame:
    """All that the references of some parts reach, each with the least evidence"""
    part = table(spark, d, "part")
    lines = part.select(F.col("p_partkey").alias("src"), (F.col("p_size") % 17).cast("int").alias("line"), F.col("p_name").alias("raw"))
    return reach.least_evidence(part_edges(spark, d).select("src", "dst").join(lines, "src"), part.where(_OWNERS).select(F.col("p_partkey").alias("owner")))


@query(f"""
WITH RECURSIVE {EDGES_SQL}, s AS (SELECT p_partkey AS source FROM part WHERE p_size % 7 = 0
), r(source, node, depth) AS (SELECT source, source, 0 FROM s UNION SELECT r.source, e.dst, r.depth + 1 FROM r JOIN e ON r.node = e.src
), g AS (SELECT node, min(depth) AS depth, count(DISTINCT source) AS n, string_agg(DISTINCT CAST(source AS VARCHAR), ',' ORDER BY CAST(source AS VARCHAR)) AS sources FROM r GROUP BY node)
SELECT p_partkey AS node, 'authoritative' AS mode, CASE WHEN p_size % 3 = 0 THEN 'not-evaluated' WHEN n IS NULL THEN 'not-reached' ELSE 'reachable' END AS state,
  CASE WHEN p_size % 3 = 0 THEN 'skill-not-discovery-eligible' WHEN p_size % 7 = 0 THEN 'published-entrypoint' WHEN n IS NULL THEN 'no-usable-path-from-published-entrypoint' ELSE 'reachable-through-usable-route' END AS reason,
  CAST(CASE WHEN p_size % 3 <> 0 THEN depth END AS INTEGER) AS depth, CAST(CASE WHEN p_size % 3 <> 0 THEN coalesce(n, 0) ELSE 0 END AS INTEGER) AS n_sources,
  sha256(CASE WHEN p_size % 3 <> 0 THEN coalesce(sources, '') ELSE '' END) AS sources_hash
FROM part LEFT JOIN g ON node = p_partkey
""")
def route_reachability(spark: SparkSession, d: str) -> DataFrame:
    """By which published parts each part is reached"""
    part = table(spark, d, "part")
    nodes = part.select(F.col("p_partkey").alias("node"), (F.col("p_size") % 3 != 0).alias("eligible"))
    out = reach.route_reachability(nodes, part_edges(spark, d), part.where("p_size % 7 = 0").select(F.col("p_partkey").alias("source")), "adopted")
    names = F.array_join(F.array_sort(F.transform("sources", lambda x: x.cast("string"))), ",")
    return out.select("node", "mode", "state", "reason", "depth", F.size("sources").alias("n_sources"), F.sha2(names, 256).alias("sources_hash"))


# Skills are suppliers, surfaces parts (owned by a supplier, some of them locally), invocations line items, dependencies the edges of parts.
_GRAPH_SQL = f"""
WITH {EDGES_SQL}, k AS (SELECT 's' || s_suppkey AS skill FROM supplier
), p AS (SELECT 'p' || p_partkey AS path, 's' || (p_partkey % 10) AS owner, p_size % 2 = 0 AS is_local FROM part WHERE p_size % 5 <> 0
), i AS (SELECT 's' || l_suppkey AS source, CASE WHEN l_returnflag = 'R' AND l_partkey % 13 = 0 THEN 'x' || l_linenumber ELSE 'p' || l_partkey END AS target, l_returnflag = 'R' AND l_partkey % 13 = 0 AS is_out FROM lineitem
), a AS (
  SELECT owner AS source, path AS target, 'contains' AS kind, 'structural-boundary' AS declaration, TRUE AS resolved, CAST(NULL AS BIGINT) AS evidence FROM p WHERE is_local AND owner IN (SELECT skill FROM k)
  UNION ALL SELECT source, target, 'invokes', 'executable-invocation', NOT is_out, count(*) FROM i WHERE source IN (SELECT skill FROM k) AND (is_out OR target IN (SELECT path FROM p)) GROUP BY source, target, is_out
  UNION ALL SELECT 'p' || src, 'p' || dst, 'invokes', 'executable-dependency', TRUE, count(*) FROM e WHERE 'p' || src IN (SELECT path FROM p) AND 'p' || dst IN (SELECT path FROM p) GROUP BY src, dst
)"""


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    out = "l_returnflag = 'R' and l_partkey % 13 = 0"
    surfaces = table(spark, d, "part").where("p_size % 5 <> 0").selectExpr("concat('p', p_partkey) path", "concat('s', p_partkey % 10) owner", "p_size % 2 = 0 local")
    invocations = table(spark, d, "lineitem").selectExpr("concat('s', l_suppkey) source", f"case when {out} then concat('x', l_linenumber) else concat('p', l_partkey) end target", f"{out} external")
    needs = part_edges(spark, d).selectExpr("concat('p', src) src", "concat('p', dst) dst")
    return reach.executable_graph(table(spark, d, "supplier").selectExpr("concat('s', s_suppkey) skill"), surfaces, invocations, needs)


@query(f"{_GRAPH_SQL} SELECT * FROM a")
def executable_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """Containment, invocations and dependencies, with their evidence"""
    return _graph(spark, d)[0]


@query(f"""{_GRAPH_SQL}, c AS (SELECT DISTINCT source, target FROM a WHERE kind = 'invokes'
), n AS (SELECT skill AS node, 'skill' AS role FROM k UNION SELECT path, 'surface' FROM p UNION SELECT target, 'external-executable' FROM a WHERE NOT resolved)
SELECT node, role, CAST(count(DISTINCT CASE WHEN source IN (SELECT skill FROM k) THEN source END) AS BIGINT) AS invoked_by_skills, CAST(count(DISTINCT source) AS BIGINT) AS fan_in FROM n LEFT JOIN c ON target = node GROUP BY node, role
""")
def executable_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Skills, surfaces and external targets, with the fan-in of shared targets"""
    return _graph(spark, d)[1]


BEFORE = boundaries.Boundary("before", globs=("en/**", "de/**"), exclude=("en/7", "4"), max_file_size=700, max_depth=3)
AFTER = boundaries.Boundary("after", globs=("**",), exclude=("4", "fr"), max_file_size=500, max_depth=1)


@query(r"""
WITH p AS (SELECT DISTINCT ltrim(coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1), ''), '/'), '/') AS path, max(length(html)) AS size FROM pages GROUP BY 1
), s AS (SELECT path, CASE WHEN len(string_split(path, '/')) - 1 > 3 THEN 'too-deep' WHEN list_contains(string_split(path, '/'), '4') OR path = 'en/7' OR starts_with(path, 'en/7/') OR starts_with(path, '4/') THEN 'excluded' WHEN NOT regexp_matches(path, '^(en|de)/') THEN 'not-included' WHEN size > 700 THEN 'too-large' ELSE 'inspected' END AS a,
  CASE WHEN len(string_split(path, '/')) - 1 > 1 THEN 'too-deep' WHEN list_contains(string_split(path, '/'), '4') OR list_contains(string_split(path, '/'), 'fr') THEN 'excluded' WHEN size > 500 THEN 'too-large' ELSE 'inspected' END AS b FROM p)
SELECT path, a = 'inspected' OR b = 'inspected' AS inspected, concat_ws(',', CASE WHEN a = 'inspected' THEN 'before' END, CASE WHEN b = 'inspected' THEN 'after' END) AS boundaries, a || ',' || b AS states FROM s
""")
def boundary_union(spark: SparkSession, d: str) -> DataFrame:
    """Pages under two boundaries, and what they cover together"""
    path = F.regexp_replace(path_of(F.col("url")), "^/+", "")
    paths = table(spark, d, "pages").groupBy(path.alias("path")).agg(F.max(F.length("html")).alias("size"))
    return boundaries.union_scan(paths, (BEFORE, AFTER)).withColumn("boundaries", F.array_join("boundaries", ",")).withColumn("states", F.array_join("states", ","))


@query("""
WITH a AS (SELECT p_brand AS id, 'src' || p_size AS path, p_name AS reason, CASE WHEN p_partkey % 5 = 0 THEN 'never' ELSE strftime(DATE '1999-01-01' + CAST(p_partkey % 400 AS INTEGER), '%Y-%m-%d') END AS expires FROM part
), b AS (SELECT p_brand AS id, 'src' || p_size AS path, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE strftime(DATE '1999-03-01' + CAST(p_partkey % 300 AS INTEGER), '%Y-%m-%d') END AS expires FROM part WHERE p_partkey % 4 <> 0
), x AS (SELECT id, path, CASE WHEN expires = 'never' THEN '9999-12-31' ELSE expires END AS last, reason FROM a WHERE expires = 'never' OR expires >= '1999-06-30'
), y AS (SELECT id, path, max(coalesce(expires, '9999-12-31')) AS last FROM b WHERE expires IS NULL OR expires >= '1999-06-30' GROUP BY id, path
), z AS (SELECT *, row_number() OVER (PARTITION BY id, path ORDER BY last DESC, encode(reason) DESC) AS n FROM x)
SELECT z.id, z.path, z.reason, CASE WHEN least(z.last, y.last) = '9999-12-31' THEN 'never' ELSE least(z.last, y.last) END AS expires FROM z JOIN y ON z.id = y.id AND z.path = y.path WHERE n = 1
""")
def trusted_suppressions(spark: SparkSession, d: str) -> DataFrame:
    """Suppressions that both sides trust, with the stricter end"""
    day = lambda first, n: F.date_format(F.date_add(F.lit(first).cast("date"), (F.col("p_partkey") % n).cast("int")), "yyyy-MM-dd")
    part = table(spark, d, "part").withColumn("path", F.concat(F.lit("src"), "p_size"))
    before = part.select(F.col("p_brand").alias("id"), "path", F.col("p_name").alias("reason"), F.when(F.col("p_partkey") % 5 == 0, "never").otherwise(day("1999-01-01", 400)).alias("expires"))
    after = part.where("p_partkey % 4 <> 0").select(F.col("p_brand").alias("id"), "path", F.col("p_name").alias("reason"), F.when(F.col("p_partkey") % 3 != 0, day("1999-03-01", 300)).alias("expires"))
    return boundaries.trusted_suppressions(before, after, "1999-06-30")


# Handbooks made of customers: a section and a code block for each segment and nation, headings that come back, and generic ones.
_BODY = "concat('The ', lower(c_mktsegment), ' team of nation ', c_nationkey, ' reviews every order before it is shipped and records who approved it, when it was approved, which supplier was asked, and what the customer was told about the delivery, the price and the terms of the contract.')"
HANDBOOK = (
    f"concat('# Handbook of ', c_name, chr(10), chr(10), '## How the ', lower(c_mktsegment), ' team works #', chr(10), {_BODY}, chr(10), chr(10), '## Usage', chr(10), '```sh', chr(10), 'run --nation ', c_nationkey % 5, ' --segment ', lower(c_mktsegment), ' --output reports/summary.json --verbose --retries 3 --timeout 60', chr(10), '```', chr(10), '### Details', chr(10), 'n', c_custkey)"
)
_HEAD = r"^ {0,3}#{1,6}([ \t]|$)"
_TOKENS = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_./:+\-=]*|[^\s\p{{L}}\p{{N}}_]{{1,3}}'))"
_PARTS_SQL = rf"""
WITH d AS (SELECT CAST(c_custkey AS VARCHAR) AS path, string_split({HANDBOOK}, chr(10)) AS x FROM customer
), l AS (SELECT path, x, unnest(range(1, len(x) + 1)) AS i FROM d
), f AS (SELECT path, x, list_filter(range(1, len(x) + 1), lambda i: x[i] LIKE '```%') AS marks FROM d
), h AS (SELECT l.path, l.x, i, length(regexp_extract(x[i], '^ *(#+)', 1)) AS depth FROM l WHERE regexp_matches(x[i], '{_HEAD}')
), s AS (SELECT h.path, h.x, h.i AS a, coalesce((SELECT min(o.i) FROM h o WHERE o.path = h.path AND o.i > h.i AND o.depth <= h.depth) - 1, len(h.x)) AS b FROM h
), t AS (SELECT path, a, b, trim(regexp_replace(array_to_string(x[a : b], chr(10)), '\s+', ' ', 'g')) AS normal, lower(regexp_replace(regexp_replace(trim(regexp_replace(x[a], '\s+', ' ', 'g')), '^#+\s*', ''), '\s+#+$', '')) AS title FROM s
), c AS (SELECT path, marks[1] AS a, marks[2] AS b, trim(regexp_replace(array_to_string(x[marks[1] + 1 : marks[2] - 1], chr(10)), '\s+', ' ', 'g')) AS normal FROM f
), p AS (
  SELECT 'section_hash' AS kind, sha256(normal) AS key, path, a FROM t WHERE length(normal) >= 240 AND {_TOKENS.format("normal")} >= 40
  UNION ALL SELECT 'heading', title, path, a FROM t WHERE length(title) >= 24 AND {_TOKENS.format("title")} >= 3
  UNION ALL SELECT 'code_block', sha256('sh' || chr(10) || normal), path, a FROM c WHERE length(normal) >= 80 AND {_TOKENS.format("normal")} >= 10
), g AS (SELECT kind, key, count(DISTINCT path) AS n_docs, count(*) AS n, min({{'p': path, 'a': a}}) AS f FROM p GROUP BY kind, key HAVING count(DISTINCT path) >= CASE kind WHEN 'heading' THEN 3 ELSE 2 END)"""


@query(f"{_PARTS_SQL} SELECT kind, key, CAST(n_docs AS BIGINT) AS n_docs, CAST(n AS BIGINT) AS n, f.p AS path, CAST(f.a AS INTEGER) AS start_line FROM g")
def repeated_parts(spark: SparkSession, d: str) -> DataFrame:
    """Sections, headings and code blocks that come back"""
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.expr(HANDBOOK).alias("text"))
    return repeats.repeated_parts(repeats.document_parts(docs, "id", "text")).drop("label")


@query(f"""{_PARTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n_docs DESC, n DESC, CASE kind WHEN 'section_hash' THEN 'section hash ' || key[1:12] WHEN 'code_block' THEN 'sh code block ' || key[1:12] ELSE key END, key) AS rank FROM g)
SELECT kind, key, CAST(n_docs AS BIGINT) AS n_docs, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10
""")
def repeated_parts_report(spark: SparkSession, d: str) -> DataFrame:
    """The ten largest groups of each kind"""
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.expr(HANDBOOK).alias("text"))
    return repeats.capped(repeats.repeated_parts(repeats.document_parts(docs, "id", "text"))).select("kind", "key", "n_docs", "rank")
