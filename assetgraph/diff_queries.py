"""Registered queries of two snapshots: edges, checks, scan boundaries, thresholds, gates and the report over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import diff
from .queries import query, table


@query("""
WITH l AS (SELECT l_orderkey AS source, l_returnflag AS kind, l_partkey AS target, l_linenumber AS n, l_suppkey AS s, l_quantity > 10 AS was, l_quantity > 20 AS now FROM lineitem
), a AS (SELECT source, kind, target, max_by(was, n * 10 + CAST(was AS INT)) AS r FROM l WHERE s % 3 <> 0 GROUP BY ALL
), b AS (SELECT source, kind, target, max_by(now, n * 10 + CAST(now AS INT)) AS r FROM l WHERE s % 4 <> 0 GROUP BY ALL
), m AS (SELECT source, kind, target, a.r AS x, b.r AS y FROM a FULL JOIN b USING (source, kind, target))
SELECT source, kind, target, 'added' AS change FROM m WHERE x IS NULL UNION ALL SELECT source, kind, target, 'removed' FROM m WHERE y IS NULL
UNION ALL SELECT source, kind, target, 'newly_unresolved' FROM m WHERE NOT y AND x IS DISTINCT FROM FALSE UNION ALL SELECT source, kind, target, 'newly_resolved' FROM m WHERE y AND NOT x
""")
def edge_diff(spark: SparkSession, d: str) -> DataFrame:
    """D2"""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("target"), F.col("l_linenumber").alias("at"), "l_suppkey", "l_quantity")
    old = lines.where("l_suppkey % 3 <> 0").withColumn("resolved", F.col("l_quantity") > 10)
    new = lines.where("l_suppkey % 4 <> 0").withColumn("resolved", F.col("l_quantity") > 20)
    return diff.edge_diff(old, new, ["source", "kind", "target"])


_CHECKS_SQL = """
SELECT c_nationkey || ':' || c_mktsegment AS id, CASE WHEN avg(c_acctbal) < 4000 THEN 'fail' WHEN avg(c_acctbal) < 4600 THEN 'warn' ELSE 'pass' END AS status,
  CASE WHEN min(c_acctbal) < -900 THEN 'high' ELSE 'low' END AS severity, CAST(count(*) FILTER (c_acctbal < 0) AS VARCHAR) || ' of ' || count(*) AS summary
FROM customer WHERE {} GROUP BY c_nationkey, c_mktsegment
"""


@query(f"""
WITH a AS ({_CHECKS_SQL.format('c_custkey % 3 <> 0 AND c_nationkey % 7 <> 0')}), b AS ({_CHECKS_SQL.format('c_custkey % 4 <> 0')})
SELECT b.id, coalesce(a.status, 'absent') AS from_status, b.status AS to_status, coalesce(a.severity, 'absent') AS from_severity, b.severity AS to_severity, a.summary IS DISTINCT FROM b.summary AS summary_changed
FROM b LEFT JOIN a ON a.id = b.id WHERE a.id IS NULL OR a.status <> b.status OR a.severity <> b.severity OR a.summary <> b.summary
""")
def check_diff(spark: SparkSession, d: str) -> DataFrame:
    """Checks of the customers of each nation and segment"""
    c = table(spark, d, "customer")

    def checks(rows: DataFrame) -> DataFrame:
        mean = F.avg("c_acctbal")
        status = F.when(mean < 4000, "fail").when(mean < 4600, "warn").otherwise("pass")
        severity = F.when(F.min("c_acctbal") < -900, "high").otherwise("low")
        summary = F.concat_ws(" of ", F.count_if(F.col("c_acctbal") < 0).cast("string"), F.count("*").cast("string"))
        out = rows.groupBy("c_nationkey", "c_mktsegment").agg(status.alias("status"), severity.alias("severity"), summary.alias("summary"))
        return out.select(F.concat_ws(":", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("id"), "status", "severity", "summary")

    return diff.check_diff(checks(c.where("c_custkey % 3 <> 0 and c_nationkey % 7 <> 0")), checks(c.where("c_custkey % 4 <> 0")))


_BOUNDARY_SQL = """
SELECT CASE o_custkey % 4 WHEN 0 THEN 'glob' WHEN 1 THEN 'exclusion' WHEN 2 THEN 'limit' ELSE 'suppression' END AS kind, 'item' || o_custkey AS item, max(o_orderkey % 100) AS v,
  CASE WHEN count(*) FILTER (o_orderpriority = '1-URGENT') > 1 THEN NULL ELSE CAST(max(o_orderdate) AS DATE) END AS e
FROM orders WHERE {} GROUP BY o_custkey
"""


@query(f"""
WITH a AS ({_BOUNDARY_SQL.format('o_orderkey % 3 <> 0')}), b AS ({_BOUNDARY_SQL.format('o_orderkey % 4 <> 0')}), m AS (
  SELECT kind, item, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' WHEN kind = 'limit' AND b.v > a.v THEN 'raised' WHEN kind = 'limit' AND b.v < a.v THEN 'lowered'
    WHEN kind = 'suppression' AND coalesce(b.e, DATE '9999-12-31') > coalesce(a.e, DATE '9999-12-31') THEN 'lifetime_extended' WHEN kind = 'suppression' AND a.e IS DISTINCT FROM b.e THEN 'lifetime_shortened' END AS change
  FROM a FULL JOIN b USING (kind, item))
SELECT kind, item, change, CASE WHEN kind || ':' || change IN ('glob:removed', 'exclusion:added', 'limit:removed', 'limit:lowered', 'suppression:added', 'suppression:lifetime_extended') THEN 'weakening' ELSE 'tightening' END AS direction
FROM m WHERE change IS NOT NULL
""")
def boundary_diff(spark: SparkSession, d: str) -> DataFrame:
    """What is scanned, by two sets of orders"""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")

    def boundary(rows: DataFrame) -> DataFrame:
        expires = F.when(F.count_if(F.col("o_orderpriority") == "1-URGENT") <= 1, F.max("o_orderdate").cast("date"))
        out = rows.groupBy("o_custkey").agg(F.max(F.col("o_orderkey") % 100).alias("value"), expires.alias("expires"))
        kind = F.element_at(F.array(*map(F.lit, ("glob", "exclusion", "limit", "suppression"))), (F.col("o_custkey") % 4 + 1).cast("int"))
        return out.select(kind.alias("kind"), F.concat(F.lit("item"), F.col("o_custkey").cast("string")).alias("item"), "value", "expires")

    return diff.boundary_diff(boundary(orders.where("o_orderkey % 3 <> 0")), boundary(orders.where("o_orderkey % 4 <> 0")))


@query("""
WITH t AS (SELECT p_brand || ':' || p_type AS key, max(p_size) FILTER (p_partkey % 3 <> 0) AS x, max(p_size) FILTER (p_partkey % 4 <> 0) AS y FROM part GROUP BY p_brand, p_type)
SELECT key, CAST(x AS INTEGER) AS from_value, CAST(y AS INTEGER) AS to_value, CASE WHEN y > x THEN 'weakening' ELSE 'tightening' END AS direction FROM t WHERE x <> y
""")
def threshold_diff(spark: SparkSession, d: str) -> DataFrame:
    """Token thresholds"""
    key = F.concat_ws(":", "p_brand", "p_type").alias("key")
    tops = lambda rows: rows.groupBy(key).agg(F.max("p_size").alias("value"))
    part = table(spark, d, "part")
    return diff.threshold_diff(tops(part.where("p_partkey % 3 <> 0")), tops(part.where("p_partkey % 4 <> 0")))


_MODES = "(['off', 'warn', 'fail'])"
GATES_SQL = f"""
SELECT repo, gate, effective, CAST(CASE WHEN gate = 'skill_discovery' AND effective = 'off' THEN 0 ELSE n END AS BIGINT) AS match_count, CASE WHEN effective = 'off' OR n = 0 THEN 'pass' ELSE effective END AS outcome FROM (
  SELECT repo, gate, CASE WHEN gate = 'skill_discovery' THEN {_MODES}[least(greatest(x, y), 1) + 1] ELSE {_MODES}[greatest(x, y) + 1] END AS effective, coalesce(k, 0) + CASE WHEN gate IN ('metadata_policy', 'quality_policy') AND x > y THEN 1 ELSE 0 END AS n
  FROM (SELECT n_nationkey AS repo, g, gate, (n_nationkey + g) % 3 AS x, (n_nationkey * 2 + g // 2) % 3 AS y FROM nation, (SELECT unnest(range(6)) AS g, unnest([{', '.join(f"'{g}'" for g in diff.GATES)}]) AS gate))
  LEFT JOIN (SELECT c_nationkey AS repo, c_custkey % 6 AS g, count(*) AS k FROM customer WHERE c_acctbal < -500 GROUP BY ALL) USING (repo, g)
)
"""


def _gates(spark: SparkSession, d: str) -> DataFrame:
    mode = lambda x: F.element_at(F.array(*map(F.lit, diff.MODES)), (x % 3 + 1).cast("int"))
    gates = F.array(*(F.struct(F.lit(i).alias("g"), F.lit(g).alias("gate")) for i, g in enumerate(diff.GATES)))
    modes = table(spark, d, "nation").select(F.col("n_nationkey").alias("repo"), F.explode(gates).alias("x")).select("repo", "x.gate", mode(F.col("repo") + F.col("x.g")).alias("from"), mode(F.col("repo") * 2 + F.floor(F.col("x.g") / 2)).alias("to"))
    name = F.element_at(F.array(*map(F.lit, diff.GATES)), (F.col("c_custkey") % 6 + 1).cast("int"))
    matches = table(spark, d, "customer").where("c_acctbal < -500").groupBy(F.col("c_nationkey").alias("repo"), name.alias("gate")).agg(F.count("*").alias("n"))
    return diff.ci_gates(modes, matches)


@query(GATES_SQL)
def ci_gates(spark: SparkSession, d: str) -> DataFrame:
    """The six gates of each nation"""
    return _gates(spark, d)


@query(f"""
SELECT repo, (['pass', 'warn', 'fail'])[max(list_position(['pass', 'warn', 'fail'], outcome))] AS status, CAST(sum(match_count) AS BIGINT) AS matches, coalesce(string_agg(gate, ',' ORDER BY gate) FILTER (outcome <> 'pass'), '') AS open_gates
FROM ({GATES_SQL}) GROUP BY repo
""")
def ci_report(spark: SparkSession, d: str) -> DataFrame:
    """D11, A21"""
    return diff.ci_report(_gates(spark, d))
