"""Destinations in a line of text: candidates by kind, the clause that each stands in, and what is done with it.

All of it is column expressions over one line.  Offsets count UTF-16 units.  A host counts as public if its longest listed
suffix is one of `suffixes`, or its last label has two letters (a country); the full list of public suffixes is a parameter, as it is
too long to be held here.  URLs are not resolved: dot segments and percent signs in paths stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shell import shell_tokens
from .spans import let, match_spans, units

# What candidates look like, and which words tie them to an action.
_LABEL = r"(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.){1,127}[a-z](?:[a-z0-9-]{0,61}[a-z0-9])?"
_IPV4 = r"(?:\d{1,3}\.){3}\d{1,3}"
URL = r"""(?i)(?:https?://|//)[^\s"'`<>{}]+"""
SHARE = r"""\\\\[^\s"'`<>{}]+"""
BARE = rf"""(?i)(?:{_LABEL}|{_IPV4})(?::\d+)?(?:[\\/][^\s"'`<>{{}}\[\]]*)?"""
ASSET_ID = r"(?i)^(?:context|skill|lens)(?:\.[a-z0-9][a-z0-9-]*)+\z"
CLAUSE_END = (
    r"(?i)\b(?:and|then)\b(?=\s+(?:(?:fetch|download|upload|send|share|attach|submit|sync|push|publish|copy|document|explain|describe|record|note|inspect|review|compare|get|post|put|curl|wget|run|validate|read|use)\b|then\b))"
    r"|[;,]|[.!?](?=\s|\z)"
)
DIRECT_BARE = r"(?i)\b(?:get|post|put|curl|wget|fetch|download)\b[^.;,!?]{0,160}\z"
DIRECT_AMBIGUOUS = r"(?i)\b(?:get|post|put|curl|wget)\b[^.;,!?]{0,160}\z"
TO_NETWORK = r"(?i)\b(?:fetch|download)\s+from\s*\z|\b(?:upload|send|attach|submit|push|publish|copy)\b[^.;,!?]{0,100}\bto\s*\z|\b(?:share|sync)\b[^.;,!?]{0,100}\bwith\s*\z"
DIRECT_UPLOAD = r"(?i)\b(?:post|put)\b[^.;,!?]{0,160}\z"
TO_UPLOAD = r"(?i)\b(?:upload|send|attach|submit|push|publish|copy)\b[^.;,!?]{0,100}\bto\s*\z|\b(?:share|sync)\b[^.;,!?]{0,100}\bwith\s*\z"
CURL_DATA = r"(?:^|\s)(?:-(?:d|F|T)|--(?:data(?:-ascii|-binary|-raw|-urlencode)?|form(?:-string)?|upload-file)(?=\s|=|\z))"
CURL_METHOD = r"(?:^|\s)-X(?:\s+|=)?(?:POST|PUT|post|put)(?=\s|\z)"
UPLOAD = r"(?i)\b(upload|send|post|share|attach|submit|sync|push|publish)\b.*\b(external|remote|third[- ]party|pastebin|gist|slack|discord|s3|gcs|cloud|storage|bucket|drive|dropbox|notion|jira|github)\b|\b(post|put)\b.*https?://"
CLOUD_UPLOAD = r"(?i)\b(upload|sync|copy|send|push|publish)\b.*\b(s3|gcs|cloud storage|bucket|drive|dropbox|box|onedrive|blob storage|azure storage|storage)\b"
NETWORK = r"(?i)\b(?:curl|wget|http|https|webhook)\b|\b(?:fetch|get|send|sync|push|upload|download|post|put)\b[^.;!?]{0,100}\b(?:external|remote|network|internet|webhook|api endpoint|server)\b"
SUFFIXES = ("com", "org", "net", "edu", "gov", "int", "mil", "info", "biz", "name", "pro", "app", "dev", "cloud", "online", "site", "store", "shop", "tech", "xyz", "page", "blog", "wiki", "news", "live", "world", "email", "tools", "zone", "run", "software", "systems", "network", "digital", "agency", "company", "academy", "arpa")
_BYTE = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_VALID_IPV4 = rf"(?:{_BYTE}\.){{3}}{_BYTE}"
_TRAIL = r"[),.;:!?]+\z"

CANDIDATE = "struct<text:string,start:int,end:int,kind:string,transport:string,host:string,path:string>"


def before16(text: Column, start: Column) -> Column:
    """The text before a UTF-16 offset."""
    return F.decode(F.substring(F.encode(text, "UTF-16BE"), F.lit(1), 2 * start), "UTF-16BE")


def slice16(text: Column, start: Column, end: Column) -> Column:
    return F.decode(F.substring(F.encode(text, "UTF-16BE"), 2 * start + 1, 2 * (end - start)), "UTF-16BE")


def normalized(candidate: Column) -> Column:
    """struct<host, path> of a candidate; null if it names no host."""

    def of(raw: Column) -> Column:
        url = raw.rlike(r"(?i)^https?://") | raw.startswith("//")
        share = raw.startswith("\\\\")
        rest = F.when(url, F.regexp_replace(raw, r"(?i)^(?:https?:)?//", "")).when(share, F.replace(F.substring(raw, F.lit(3), F.length(raw)), F.lit("\\"), F.lit("/"))).otherwise(F.replace(raw, F.lit("\\"), F.lit("/")))
        host = F.lower(F.regexp_extract(rest, r"^(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:\[\]]*)(?::\d*)?(?=[/?#\\]|\z)", 1))
        path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), r"/+\z", "")
        six, numeric = host.startswith("["), host.rlike(r"^(?:\d+\.)+\d+\.?\z") & ~host.rlike(rf"^{_VALID_IPV4}\z")
        bad = (host == "") | numeric | host.rlike(r"[\s<>^|%\\\"{}]") | (six & ~url) | (~six & ~host.contains(".") & ~url & ~share)
        return F.when((raw != "") & ~bad, F.struct(F.regexp_replace(host, r"^\[|\]\z", "").alias("host"), path.alias("path")))

    return let(F.regexp_replace(F.trim(candidate), _TRAIL, ""), of)


def is_public(host: Column, suffixes: Iterable[str] = SUFFIXES) -> Column:
    """Whether a host ends in a public suffix and has a label before it."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    listed = F.array(*(F.lit(s) for s in suffixes))
    longest = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_contains(listed, F.array_join(F.slice(labels, i + 1, n), ".")))
    return (n > 1) & ((F.size(longest) > 0) | F.element_at(labels, -1).rlike("^[a-z]{2}\\z"))


def _candidate(span: Column, kind: Column, transport: Column, goal: Column) -> Column:
    return F.struct(span["text"].alias("text"), span["start"].alias("start"), span["end"].alias("end"), kind.alias("kind"), transport.cast("string").alias("transport"), goal["host"].alias("host"), goal["path"].alias("path"))


def candidates(text: Column, suffixes: Iterable[str] = SUFFIXES) -> Column:
    """array<struct<text, start, end, kind, transport, host, path>> in order of place: explicit-url, network-share, bare-host, ambiguous-dotted-token,
    local-path, local-filename, asset-id, command-file-argument or unsupported-host."""
    none = F.lit(None).cast("string")

    def free(spans: Column, taken: Column) -> Column:
        return F.filter(spans, lambda s: ~F.exists(taken, lambda t: (s["start"] < t["end"]) & (t["start"] < s["end"])))

    def url(s: Column) -> Column:
        transport = F.when(s["text"].rlike("(?i)^https://"), "https").when(s["text"].rlike("(?i)^http://"), "http").otherwise("protocol-relative")
        return let(normalized(s["text"]), lambda g: _candidate(s, F.when(g.isNull(), "unsupported-host").otherwise("explicit-url"), transport, g))

    def share(s: Column) -> Column:
        return let(normalized(s["text"]), lambda g: _candidate(s, F.when(g.isNull(), "unsupported-host").otherwise("network-share"), none, g))

    def bare(s: Column) -> Column:
        def of(before: Column, plain: Column, goal: Column) -> Column:
            local = before.rlike(r"(?:^|[^/])/\z|(?:^|[^\\])\\\z")
            syntax = plain.rlike(r"[\\/]") | plain.rlike(r":\d+(?:[\\/]|\z)")
            none_of = F.lit(None).cast("struct<host:string,path:string>")
            kind = (
                F.when(before.endswith("@") | before.rlike(r"""(?i)(?:^|[ \t`"'])--?[a-z0-9][a-z0-9-]*=\z"""), "command-file-argument")
                .when(local, "local-path")
                .when(plain.rlike(ASSET_ID), "asset-id")
                .when(before.endswith("."), "local-filename")
                .when(goal.isNull(), "unsupported-host")
                .when(goal["host"].rlike(rf"^{_VALID_IPV4}\z"), "bare-host")
                .when(is_public(goal["host"], suffixes), F.when(syntax, "bare-host").otherwise("ambiguous-dotted-token"))
                .otherwise("local-filename")
            )
            return let(kind, lambda k: _candidate(s, k, none, F.when(k.isin("bare-host", "ambiguous-dotted-token"), goal).otherwise(none_of)))

        return let(before16(text, s["start"]), F.regexp_replace(s["text"], _TRAIL, ""), normalized(s["text"]), of)

    def rest(urls: Column, shares: Column, bares: Column) -> Column:
        every = F.concat(F.transform(urls, url), F.transform(shares, share), F.transform(bares, bare))
        longer = lambda x, y: F.coalesce(F.nullif(x["start"] - y["start"], F.lit(0)), (y["end"] - y["start"]) - (x["end"] - x["start"]))
        return F.array_sort(every, longer)

    found = let(match_spans(text, URL), lambda u: free(match_spans(text, SHARE), u), lambda u, s: free(match_spans(text, BARE), F.concat(u, s)), rest)
    return F.when(text.rlike(f"{URL}|{SHARE}|{BARE}"), found).otherwise(F.array().cast(f"array<{CANDIDATE}>"))


def masked(text: Column, spans: Column, keep_end: bool = False) -> Column:
    """text with the spans blanked; keep_end: but for ; , . ! ? at a span's end."""

    def blank(s: Column) -> Column:
        end = F.regexp_extract(s["text"], r"[;,.!?]+\z", 0) if keep_end else F.lit("")
        return F.concat(F.repeat(F.lit(" "), units(s["text"]) - units(end)), end)

    ends = F.transform(spans, lambda s, i: F.struct(F.when(i > 0, F.get(spans, F.greatest(i - 1, F.lit(0)))["end"]).otherwise(0).alias("from"), s.alias("s")))
    pieces = F.transform(ends, lambda p: F.concat(slice16(text, p["from"], F.greatest(p["s"]["start"], p["from"])), blank(p["s"])))
    tail = slice16(text, F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(0)), units(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(text)


def _action(c: Column, blanked: Column, clauses: Column, operators: Column, intent: str) -> Column:
    """What ties a candidate to an intent by the words of its clause before it, or null."""

    def network(prefix: Column) -> Column:
        direct = F.when(c["kind"] == "bare-host", prefix.rlike(DIRECT_BARE)).when(c["kind"] == "ambiguous-dotted-token", prefix.rlike(DIRECT_AMBIGUOUS)).otherwise(False)
        preposition = c["kind"].isin("bare-host", "ambiguous-dotted-token") & prefix.rlike(TO_NETWORK)
        explicit = c["transport"].isNotNull() | ((c["kind"] == "network-share") & c["host"].isNotNull())
        return F.when(explicit, "explicit-transport").when(c["host"].isNull(), F.lit(None)).when(direct, "direct-action").when(preposition, "prepositional-action")

    def upload(prefix: Column, first: Column, last: Column) -> Column:
        transfer = slice16(blanked, first, last)
        sends = transfer.rlike(CURL_DATA) | transfer.rlike(CURL_METHOD)
        plain = F.when(prefix.rlike(DIRECT_UPLOAD), "direct-action").when(prefix.rlike(TO_UPLOAD), "prepositional-action")
        return F.when(slice16(blanked, first, c["start"]).rlike(r"(?i)\bcurl\b"), F.when(sends, "curl-transfer")).otherwise(plain)

    def of(clause: Column) -> Column:
        start, end = clause["start"], clause["end"]
        prefix = F.regexp_replace(slice16(blanked, start, c["start"]), r"""[\s`*_(\[{'"“‘]+\z""", "")
        if intent == "network":
            found = let(prefix, network)
        else:
            first = F.coalesce(F.array_max(F.transform(F.filter(operators, lambda o: (o["end"] <= c["start"]) & (o["end"] > start)), lambda o: o["end"])), start)
            last = F.coalesce(F.array_min(F.transform(F.filter(operators, lambda o: (o["start"] >= c["start"]) & (o["start"] < end)), lambda o: o["start"])), end)
            found = let(F.struct(prefix.alias("p"), first.alias("a"), last.alias("b")), lambda s: upload(s["p"], s["a"], s["b"]))
        return F.when((c["host"].isNotNull() | c["transport"].isNotNull()) & clause.isNotNull(), found)

    return let(F.get(F.filter(clauses, lambda x: (x["start"] <= c["start"]) & (c["start"] < x["end"])), F.lit(0)), of)


def _actions(intent: str) -> Callable[[Column], Column]:
    return lambda c: _action(c, F.col("masked"), F.col("_clauses"), F.col("_operators"), intent)


def _with_lists(text: Column, spans: Column, actions: Column) -> Column:
    """actions, and list-continuation for candidates that go on a list whose last one has an action."""

    def step(state: Column, x: Column) -> Column:
        c, own = x["c"], x["own"]
        overlaps = (state["end"] >= 0) & (c["start"] < state["end"]) & (state["start"] < c["end"])
        raw = slice16(text, state["start"], state["end"])
        gap = F.concat(F.regexp_extract(raw, r",+\z", 0), slice16(text, state["end"], F.greatest(c["start"], state["end"])))
        listed = state["on"] & ~overlaps & (c["start"] >= state["end"]) & ~F.regexp_extract(raw, _TRAIL, 0).rlike("[.;:!?]") & gap.rlike(r"(?i)^(?:\s|,|\band\b|\bor\b)+\z") & gap.rlike(r"(?i),|\b(?:and|or)\b")
        found = F.coalesce(own, F.when((c["host"].isNotNull() | c["transport"].isNotNull()) & listed, "list-continuation"))
        return F.struct(
            F.when(overlaps, F.least(state["start"], c["start"])).otherwise(c["start"]).alias("start"),
            F.when(overlaps, F.greatest(state["end"], c["end"])).otherwise(c["end"]).alias("end"),
            (found.isNotNull() | (overlaps & state["on"])).alias("on"),
            F.array_append(state["found"], found).alias("found"),
        )

    begin = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit(False).alias("on"), F.array().cast("array<string>").alias("found"))
    return F.aggregate(F.zip_with(spans, actions, lambda c, a: F.struct(c.alias("c"), a.alias("own"))), begin, step)["found"]


def _clause_ends(prose: Column) -> Column:
    return match_spans(prose, CLAUSE_END)


def with_destinations(df: DataFrame, text_col: str = "content", suffixes: Iterable[str] = SUFFIXES) -> DataFrame:
    """df with candidates, masked, network, upload, is_network and is_upload; network and upload hold the action that ties each candidate to that intent, or null.

    Each step is a column of its own, so that no text is scanned twice.
    """
    text = F.col(text_col)
    out = df.withColumn("candidates", candidates(text, suffixes))
    out = out.withColumn("masked", masked(text, F.col("candidates"))).withColumn("_ends", _clause_ends(masked(text, F.col("candidates"), keep_end=True)))
    starts = F.concat(F.array(F.lit(0)), F.transform("_ends", lambda e: e["end"]))
    stops = F.concat(F.transform("_ends", lambda e: e["start"]), F.array(units(text)))
    out = out.withColumn("_clauses", F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), b.alias("end"))))
    operators = F.filter(shell_tokens(F.col("masked"))["tokens"], lambda t: (t["kind"] == "operator") & t["value"].isin(";", "|", "||", "&&", "&"))
    out = out.withColumn("_operators", operators)
    for intent in ("network", "upload"):
        out = out.withColumn(f"_{intent}", F.transform("candidates", _actions(intent)))
    for intent in ("network", "upload"):
        out = out.withColumn(intent, _with_lists(text, F.col("candidates"), F.col(f"_{intent}")))
    some = lambda c: F.exists(c, lambda x: x.isNotNull())
    out = out.withColumn("is_network", F.coalesce(some("network") | F.col("masked").rlike(NETWORK), F.lit(False)))
    out = out.withColumn("is_upload", F.coalesce(F.col("masked").rlike(UPLOAD) | F.col("masked").rlike(CLOUD_UPLOAD) | some("upload"), F.lit(False)))
    return out.drop("_ends", "_clauses", "_operators", "_network", "_upload")
