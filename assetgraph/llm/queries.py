"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann_search import search
from .bpe import encode_bpe
from .common import fold, read_table
from .decontaminate import find_contamination
from .jaccard_join import jaccard_components
from .language_id import identify_language
from .lexical_search import lexical_search
from .license_scan import LEAST, NEAR, TEMPLATES, scan_licenses
from .mixing import scheduled_mix
from .quality import resample
from .secret_scan import spans_only
from .substring_dedup import remove_repeats
from .toxicity import score_toxicity
from .whitening import whiten


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 over documents; learns from labels outside the held-out fold."""
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    out = score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "clauses")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2 over documents and benchmark."""
    return find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("items")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 over documents."""
    return spans_only(read_table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 over documents."""
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5 over documents: half of them are sampled towards texts labelled good."""
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 over documents, five-word shingles, similarity 0.8."""
    return jaccard_components(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 over documents, windows of 13 words."""
    kept = remove_repeats(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 over documents; learns from the rows outside the held-out fold."""
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    out = identify_language(read_table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 over embeddings; every twentieth id asks."""
    return search(read_table(spark, sf_dir, "embeddings"), lambda v: F.pmod(v, F.lit(20)) == 0)


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 over documents: words taken by the copies of the training schedule, and the first copy's position."""
    return scheduled_mix(read_table(spark, sf_dir, "documents")).withColumn("position", F.round("position", 6))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11 over documents, with a public vocabulary file."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = encode_bpe(read_table(spark, sf_dir, "documents"), path, decode=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12 over embeddings."""
    return whiten(read_table(spark, sf_dir, "embeddings"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13: the ten best documents for each benchmark item."""
    return lexical_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_decontaminate": op2_decontaminate,
    "op3_secrets": op3_secrets,
    "op4_licenses": op4_licenses,
    "op5_quality": op5_quality,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_language_id": op8_language_id,
    "op9_ann": op9_ann,
    "op10_mix": op10_mix,
    "op11_bpe": op11_bpe,
    "op12_whiten": op12_whiten,
    "op13_search": op13_search,
}

OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(regexp_replace(coalesce(text, ''), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]', ' ', 'g'), '[^ ]+') AS w0 FROM documents
), dw AS (SELECT doc_id, r, list_transform(w0, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM d
), i AS (
  SELECT item_id, regexp_extract_all(regexp_replace(coalesce(text, ''), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]', ' ', 'g'), '[^ ]+') AS w0 FROM benchmark
), iw AS (SELECT item_id, list_transform(w0, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM i WHERE len(w0) > 0
), win AS (
  SELECT item_id, least(13, len(w)) AS n, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS p FROM iw)
), lens AS (SELECT DISTINCT n FROM win
), pos AS (
  SELECT r, p, n, array_to_string(w[p : p + n - 1], ' ') AS k
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, lens WHERE len(w) >= n)
), hit AS (SELECT pos.r, pos.p, pos.n, win.item_id FROM pos JOIN win ON pos.k = win.k AND pos.n = win.n
), words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hit) GROUP BY r
), items AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

_LISTED = ", ".join(f"('{name}#{i}', '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for name, texts in TEMPLATES.items() for i, text in enumerate(texts))
_GRAMS = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
_NORMAL = "list_filter(string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')"
OP4_SQL = rf"""
WITH t AS (SELECT template, name, {_GRAMS} AS g FROM (SELECT template, name, {_NORMAL.format("text")} AS w FROM (VALUES {_LISTED}) v(template, name, text))
), x AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_replace(text, '\r\n?', chr(10), 'g') AS text FROM documents WHERE text IS NOT NULL
), y AS (
  SELECT doc_id, r, text, string_split(text, chr(10)) AS lines, string_split(regexp_replace(text, '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10)) AS sentences, string_split_regex(text, '\n[ \t\n]*\n') AS runs FROM x
), k AS (
  SELECT p.template, o.template AS other, list_filter(p.g, lambda x: NOT list_contains(o.g, x)) AS d FROM t p JOIN t o ON p.name <> o.name
  WHERE 2 * len(list_intersect(p.g, o.g)) >= {NEAR} * (len(p.g) + len(o.g))
), c AS (
  SELECT p.template, o.template AS holder FROM t p JOIN t o ON p.name <> o.name WHERE 10 * len(list_intersect(p.g, o.g)) >= 9 * len(p.g) AND 10 * len(o.g) >= 11 * len(p.g)
), u AS (
  SELECT doc_id, r, unnest(range(len(x))) AS unit, unnest(x) AS line FROM (
    SELECT doc_id, r, list_distinct(list_concat(lines, sentences, runs, [text], list_transform(range(1, len(runs)), lambda i: runs[i] || chr(10) || runs[i + 1]),
      list_transform(range(1, len(runs) - 1), lambda i: runs[i] || chr(10) || runs[i + 1] || chr(10) || runs[i + 2]))) AS x FROM y)
), b AS (SELECT doc_id, r, unit, len(g) AS own, unnest(g) AS gram FROM (SELECT doc_id, r, unit, {_GRAMS} AS g FROM (SELECT doc_id, r, unit, {_NORMAL.format("line")} AS w FROM u)
    WHERE NOT regexp_matches(array_to_string(w, ' '), '\b(not|never|no longer) ([a-z0-9]+ ){{0,2}}(licensed|released|available)\b'))
), h AS (
  SELECT doc_id, r, unit, template, name, 2 * count(*) / (own + size) AS dice, list(gram) AS held FROM b JOIN (SELECT template, name, len(g) AS size, unnest(g) AS gram FROM t) USING (gram) GROUP BY doc_id, r, unit, template, name, own, size
), q AS (SELECT * FROM h WHERE dice >= {LEAST} AND NOT EXISTS (SELECT 1 FROM k WHERE k.template = h.template AND len(k.d) > 0 AND 2 * len(list_intersect(h.held, k.d)) <= len(k.d))
), n AS (SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM c JOIN q x ON x.template = c.holder WHERE c.template = q.template AND x.r = q.r)
), m AS (SELECT * EXCLUDE (held), max(dice) OVER (PARTITION BY doc_id, r, unit) AS most FROM n WHERE dice >= {LEAST}
), f AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS licences, count(DISTINCT r || ':' || unit) AS n_units, max(dice) AS best FROM m WHERE dice = most GROUP BY doc_id)
SELECT d.doc_id, coalesce(licences, '') AS licences, CAST(coalesce(n_units, 0) AS BIGINT) AS n_units, coalesce(best, 0.0) AS best FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN f ON d.doc_id = f.doc_id
"""

OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + least(5, len(w)) - 1], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS p FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 80 * (p.n + q.n - i)
), e AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a
), c AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.m, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (SELECT doc_id, r, p, sha256(array_to_string(w[p : p + 12], ' ')) AS k FROM (SELECT doc_id, r, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)
), firsts AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k
), gone AS (SELECT DISTINCT r, unnest(range(p, p + 13)) AS q FROM win JOIN firsts USING (k) WHERE f < doc_id
), words AS (SELECT r, unnest(range(1, len(w) + 1)) AS q, unnest(w) AS x FROM d
), kept AS (SELECT words.r, count(*) AS n, string_agg(x, ' ' ORDER BY words.q) AS s FROM words ANTI JOIN gone ON words.r = gone.r AND words.q = gone.q GROUP BY words.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source
), r AS (SELECT source, source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS rank FROM s
), w AS (SELECT *, CAST(CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM r
), f AS (
  SELECT *, 2.0 * source_size / weight AS ratio, coalesce(sum(source_size) OVER o, 0) AS held, coalesce(sum(weight) OVER o, 0) AS filled
  FROM w WINDOW o AS (ORDER BY 2.0 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT (1.5 * (SELECT sum(source_size) FROM s) - 2.0 * held) / ((SELECT sum(weight) FROM w) - filled) AS level, ratio, rank FROM f
), t AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size, rank, 0.5 * (rank % 3 - 1) AS m,
    CAST(least(coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, rank LIMIT 1), 'infinity') * weight, 2.0 * source_size) AS DOUBLE) AS target FROM w
), x AS (
  SELECT doc_id, size, source_size, target, m, CAST(round(target) AS BIGINT) AS goal,
    coalesce(sum(size) OVER (PARTITION BY rank ORDER BY md5(concat_ws(':', CAST(doc_id AS VARCHAR), CAST(size AS VARCHAR))), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(size, goal - begun)) + greatest(0, least(size, goal - begun - source_size)) AS BIGINT) AS taken,
  CASE WHEN size > 0 AND begun < goal THEN round(CASE WHEN m = 0 THEN begun / goal ELSE (sqrt((1 - m) * (1 - m) + 4 * m * (begun / goal)) - (1 - m)) / (2 * m) END, 6) END AS position
FROM x
"""

OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents
), dw AS (SELECT r, doc_id, regexp_extract_all(regexp_replace(x, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]', ' ', 'g'), '[^ ]+') AS w FROM d
), i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]', ' ', 'g'), '[^ ]+')) AS term FROM benchmark
), c AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_words FROM dw WHERE len(w) > 0
), m AS (SELECT r, doc_id, w, 100 - 90 + ((90 * len(w) * n_docs) // n_words) AS m FROM dw, c WHERE len(w) > 0
), p AS (SELECT r, doc_id, m, term, count(*) AS tf FROM (SELECT r, doc_id, m, unnest(w) AS term FROM m) GROUP BY ALL
), f AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, c WHERE term IN (SELECT term FROM i) GROUP BY term
), s AS (
  SELECT item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM i JOIN f USING (term) JOIN p USING (term) GROUP BY item_id, r, doc_id
), o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 10
"""

ORACLE_SQL: dict[str, str] = {
    "op10_mix": OP10_SQL,
    "op13_search": OP13_SQL,
    "op2_decontaminate": OP2_SQL,
    "op4_licenses": OP4_SQL,
    "op6_jaccard_join": OP6_SQL,
    "op7_substring_dedup": OP7_SQL,
}
