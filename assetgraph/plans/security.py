"""Security findings of instruction lines: one scan of all lines for all rules, with the facts of commands and destinations.

Lines are plain text.  A rule is a row of `DEFINITIONS` and a condition over the columns that the scan has made of a line; a
line that no rule can concern is dropped by one pattern before anything is parsed.  A guard is looked for on the line and in the six lines of text before it.
Findings that share a rule's key in one document count once, the first of them.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.destinations import CLOUD_UPLOAD, before16, with_destinations
from ..functions.selectors import npm_selector, python_selector
from ..functions.shell import shell_tokens
from ..functions.spans import let, match_spans, running_max
from ..operators import commands
from .scratch import dealt

# Rules by id: severity, confidence, risk class, title.
DEFINITIONS = {
    "SEC-UNPINNED-REMOTE-SCRIPT": ("high", "high", "suspicious", "Remote install script is not pinned"),
    "SEC-UNPINNED-DEPENDENCY-INSTALL": ("medium", "medium", "suspicious", "Dependency install is not pinned"),
    "SEC-RISKY-OPERATION-ERROR-SUPPRESSION": ("high", "high", "violation", "Risky operation failure is explicitly suppressed"),
    "SEC-PRIVILEGED-COMMAND-WITHOUT-GUARD": ("medium", "medium", "suspicious", "Privileged command lacks a review guard"),
    "SEC-DESTRUCTIVE-COMMAND": ("high", "high", "violation", "Destructive command lacks a review guard"),
    "SEC-CREDENTIAL-IN-COMMAND-ARG": ("high", "high", "violation", "Command includes credential material in arguments"),
    "SEC-PREDICTABLE-TEMP-PATH": ("low", "medium", "suspicious", "Instruction uses predictable temporary path for sensitive material"),
    "SEC-DANGEROUS-TOOL-INSTRUCTION": ("high", "high", "violation", "Instruction uses a disallowed tool or command"),
    "SEC-EXTERNAL-UPLOAD-INSTRUCTION": ("medium", "high", "suspicious", "Instruction sends repository data to an external destination"),
    "SEC-BULK-DATA-SHARING-INSTRUCTION": ("medium", "medium", "suspicious", "Instruction asks to share broad repository or context data"),
    "SEC-CLOUD-UPLOAD-INSTRUCTION": ("medium", "medium", "suspicious", "Instruction uploads data to cloud storage or cloud services"),
    "SEC-OVERBROAD-CONTEXT-INSTRUCTION": ("medium", "medium", "suspicious", "Instruction requests overbroad context collection"),
    "SEC-NO-REDACTION-INSTRUCTION": ("high", "high", "violation", "Instruction discourages redaction of sensitive data"),
    "SEC-SENSITIVE-FILE-REFERENCE": ("high", "high", "suspicious", "Instruction references a sensitive file"),
    "SEC-SECRET-MATERIAL-INSTRUCTION": ("high", "high", "violation", "Instruction exposes secret material"),
    "SEC-UNAPPROVED-NETWORK-DESTINATION": ("high", "high", "violation", "Instruction uses a destination that is not approved"),
}
# Patterns of the rules.
APPROVAL = r"(?i)\b(ask|prompt|require|obtain|wait for)\b.{0,50}\b(human|user|owner|maintainer|reviewer|security)?\s*(approval|confirmation|consent|authorization|review)\b|\b(human|user|owner|maintainer|reviewer|security)\b.{0,50}\b(approve|approval|confirm|confirmation|review|consent|authorize|authorization)\b|\bonly\b.{0,20}\b(after|with)\b.{0,40}\b(explicit\s+)?(human|user|owner|maintainer|reviewer|security)?\s*(approval|confirmation|review|authorization)\b|\bdo\s+not\s+run\s+automatically\b.{0,60}\b(human|user|maintainer|review|approval|confirmation)\b"
WEAK_APPROVAL = r"(?i)\b(no approval|approval (?:is )?unavailable|approval is not|approval isn't|approved by default|approval by default|without (?:approval|confirmation|authorization)|automatically approved|safe|run carefully|make sure it works)\b"
PERMISSIVE = r"(?i)\b(no approval is needed|approved by default|safe to run)\b"
RECOVERY = r"(?i)\b(create|make|take|keep|verify|confirm|document|check|use|run)\b.{0,40}\b(backup|rollback|roll back|restore|dry[- ]run|revert)\b|\b(backup|rollback|roll back|restore|dry[- ]run|revert)\b.{0,40}\b(first|before|steps?|plan|guidance|confirm|verify|check)\b"
DEFENSIVE = r"(?i)\b(do\s+not|don't|never|avoid|exclude|skip|omit|forbid|forbidden|disallow|block)\b.{0,80}\b(upload|send|post|put|share|attach|submit|sync|push|publish|copy|paste|include|print|cat|echo|log|dump|curl|wget|pipe|bash|sh|sudo|chmod|chown|rm\s+-|git\s+reset|git\s+clean|delete|install|add)\b"
GUARDED = r"(?i)\b(only|unless|after|with|before)\b.{0,80}\b(approval|approved|confirmation|confirm|human review|maintainer review|redact|redacted|redaction|dry[- ]run|backup|rollback)\b|\b(redact|redacted|redaction|approval|approved|confirmation|confirm|human review|maintainer review|dry[- ]run|backup|rollback)\b.{0,80}\b(before|after|upload|send|post|put|share|sudo|rm\s+-|git\s+reset|git\s+clean|delete|install|add)\b"
REMOTE_SCRIPT = r"(?i)\b(curl|wget)\b[^\n]*?(https?://[^\s|`'\")]+)[^\n]*\|\s*(sh|bash|zsh)\b"
PINNED_SCRIPT = r"(?i)\b(sha256|sha512|checksum|gpg|cosign|sigstore|version|v\d+\.\d+\.\d+|@[a-f0-9]{7,40})\b"
PRIVILEGED = r"(?i)\b(sudo|chmod\s+(777|666|\+w|a\+w)|chown\b|docker\s+run\b[^\n]*(--privileged|-v\s+/|--pid=host)|mount\b|launchctl\b|systemctl\b)\b"
DESTRUCTIVE = r"(?i)\b(rm\s+-[^\n]*[rf][^\n]*|git\s+reset\s+--hard|git\s+clean\s+-[^\n]*[xdf][^\n]*|docker\s+(?:rm|rmi|system\s+prune|volume\s+rm)\b|kubectl\s+delete\b|drop\s+database|truncate\s+table)\b"
_CREDENTIAL = r"(?:token|password|passwd|secret|credential|api[-_]?key|key|cert|certificate|signing[-_]?key|auth)(?:=|\s+)"
_MOCK = r"""(?!<|\$|\{|\[|REDACTED|redacted|xxx|XXX|placeholder|example)[^\s"'`]+"""
CREDENTIAL = rf"(?i)--?{_CREDENTIAL}{_MOCK}|\bAuthorization:\s*Bearer\s+{_MOCK}"
CREDENTIAL_ANY = rf"""(?i)--?{_CREDENTIAL}[^\s"'`]+"""
TEMP = r"/tmp/[A-Za-z0-9._/-]+"
NOT_PREDICTABLE = r"(?i)mktemp|tempfile|random|unique"
SENSITIVE_TEMP = r"(?i)\b(profile|credential|credentials|secret|token|password|cert|certificate|key|signing|auth|cookie|session|log|dump)\b|/tmp/(?:token|secret)\b|/tmp/[^/\s]+\.plist\b"
BULK_SOURCE = r"(?i)\b(entire|whole|all|full|complete|raw)\b.{0,100}\b(repo|repository|workspace|codebase|project|context|logs?|files?|history|dataset|environment variables|env vars|process\.env|credentials?|credential (?:directory|folder|store)|secrets?)\b|\b(everything|all files|full logs|full context|entire repo|whole repository|all environment variables|all env vars|credential (?:directory|folder|store))\b"
DISCLOSES = r"(?i)\b(paste|upload|send|share|attach|submit|publish|post|push|print|log|dump|echo|output|export)\b|\b(includ(?:e|ed|ing)|provid(?:e|ed|ing)|load(?:ed|ing)?)\b.{0,100}\b(prompt|context|request|message|tool input)\b"
OVERBROAD = r"(?i)\b(load|read|include|attach|paste|ingest|collect|provide|send)\b.*\b(entire|whole|all|full|complete|raw)\b.*\b(repo|repository|workspace|codebase|context|logs?|files?)\b"
NO_REDACTION = r"(?i)\b(do not|don't|without|no|never)\b.{0,30}\b(redact|redaction|sanitize|mask|obfuscate)\b|\b(redact|sanitize|mask|obfuscate)\b.{0,30}\b(disabled|false|off)\b"
UNREDACTED = r"(?i)\b(raw|unredacted|unsanitized|unmasked|unfiltered)\b.{0,60}\b(logs?|environment variables|env vars|credentials?|secrets?|tokens?|customer data|personal data|repository|context)\b|\b(logs?|environment variables|env vars|credentials?|secrets?|tokens?|customer data|personal data|repository|context)\b.{0,60}\b(raw|unredacted|unsanitized|unmasked|unfiltered)\b"
CLOUD = r"(?i)\b(s3://|gs://|az://|https?://(?:[^/\s]+\.)?(?:s3|storage|blob|drive|dropbox|box|onedrive|pastebin|gist|slack|discord)[^/\s]*\S*)"
SECRET_WORD = r"(?i)\b(secret|secrets|credential|credentials|token|password|passwd|api key|apikey|private key|ssh key|signing key|certificate|cert|auth)\b"
SECRET_ACTION = r"(?i)\b(copy|print|cat|echo|paste|upload|send|share|attach|include|dump|export|log|summari[sz]e)\b"
SAFE_HANDLING = r"(?i)\b(not|never|avoid|exclude|without|redact|mock|fake|sample|placeholder|dummy)\b.{0,40}\b(secret|secrets|credential|credentials|token|password|private key)\b|\b(secret|secrets|credential|credentials|token|password|private key)\b.{0,40}\b(not|never|avoid|exclude|redact|mock|fake|sample|placeholder|dummy)\b|\b(never|do not|don't|avoid|exclude|skip)\b.{0,50}\b(upload|send|share|attach|copy|paste|include|print|cat|echo|log|dump)\b|\b(upload|send|share|attach|copy|paste|include|print|cat|echo|log|dump)\b.{0,50}\b(never|do not|don't|avoid|exclude|skip)\b"
COMMAND_LIKE = r"(?i)\b(npm|pnpm|yarn|pip3?|python(?:\d+(?:\.\d+)*)?|py|uv|brew|docker|curl|wget|sudo|chmod|chown|git|gh|aws|gcloud|az|kubectl|echo|cat|cp|mv|rm|touch|mkdir)\b"
CLAUSE_BREAK = r"(?i)[;!?\n]+|\.(?=\s|\z)|\b(?:but|however|yet|then)\b"
ACTION = r"(?i)\b(?:console\.log|print|logger|log|dump|echo|output|cat|attach|include|load|provide|copy|paste|put|upload|send|share|post|publish|curl|wget)\b"
NEGATION = r"(?i)\b(?:never|do\s+not|don't|avoid|exclude|skip|omit|must\s+not|may\s+not|without)\b"
DOUBLE_NEGATION = r"(?i)\b(?:do\s+not|don't|never)\s+(?:avoid|prevent|block|stop)\b|\b(?:no|without)\s+(?:need|requirement)\b"
PROMPT_WORD = r"(?i)\b(?:prompt|agent context|context|tool input|request|message)\b"
_EXECUTABLE = r"^\s*(?:(?:[-*+$%]|\d+[.)])\s+)*+(?:[A-Za-z_]\w*=\S*\s+)*+(?:(?:\S*/)?(?:command|env)\s+(?:-\S+\s+)*+(?:[A-Za-z_]\w*=\S*\s+)*+)*+"
_SUDO = r"(?:(?:\S*/)?sudo\s+(?:-[ughpCTRD]\s+\S+\s+|--(?:user|group|host|prompt|chdir|command-timeout|chroot)\s+\S+\s+|-\S+\s+)*+(?:[A-Za-z_]\w*=\S*\s+)*+(?:(?:\S*/)?(?:command|env)\s+(?:-\S+\s+)*+(?:[A-Za-z_]\w*=\S*\s+)*+)*+)?"
MAY_CONCERN = "|".join(x.removeprefix("(?i)") for x in (COMMAND_LIKE, PRIVILEGED, DESTRUCTIVE, TEMP, DISCLOSES, OVERBROAD, NO_REDACTION, UNREDACTED, CLOUD, CREDENTIAL_ANY, r"\b(?:https?:|get|put|sync|fetch|download|attach|Authorization)\b|//|\\\\|\.[a-z]|id_|secret|credential|service-account|kubeconfig|_PATH"))

# What a text holds that has a line of MAY_CONCERN: of each pattern a word or sign that it cannot do without, none of which looks further than itself.
ANY_CONCERN = (
    r"\b(?:a(?:ttach|uthorization|ws|z)|brew|c(?:at|hmod|hown|ollect|p|url)|d(?:ocker|ownload|rop\s+database|ump)|e(?:cho|xport)|fetch|g(?:cloud|et|h|it)|https?|in(?:clude|cluded|cluding|gest)|kubectl"
    r"|l(?:aunchctl|og|oad|oaded|oading)|m(?:ask|kdir|ount|v)|npm|o(?:bfuscate|utput)|p(?:aste|ip3?|npm|ost|rint|rovide|rovided|roviding|ublish|ush|ut|y|ython\d*)|r(?:aw|ead|edact|edaction|m)"
    r"|s(?:anitize|end|hare|ubmit|udo|ync|ystemctl)|t(?:ouch|runcate\s+table)|u(?:nfiltered|nmasked|nredacted|nsanitized|pload|v)|wget|yarn)\b"
    r"|/(?:/|tmp/)|\\\\|\.[a-z]|_PATH|-(?:token|passw|api|key|cert|signing|auth)|id_|se(?:cret|rvice-account)|credential|kubeconfig"
)


@dataclass
class Policy:
    """What a repository allows; lists of a configuration."""

    disallowed: tuple[str, ...] = ()
    approved: tuple[str, ...] = ()  # hosts; none: any destination may be used
    secrets_allowed: bool | None = None
    upload_allowed: bool | None = None
    allowed_floating: tuple[str, ...] = field(default_factory=tuple)

    @property
    def declared(self) -> bool:
        return bool(self.disallowed or self.approved or self.secrets_allowed is not None or self.upload_allowed is not None)


def numbered_lines(text: Column) -> Column:
    """array<struct<line, content, block>>: block holds the line and up to six lines of text before it, back to an empty line, past empty lines that stand between."""

    def of(lines: Column) -> Column:
        last = running_max(F.transform(lines, lambda x, i: F.when(F.trim(x) != "", i + 1).otherwise(0)))

        def made(lines: Column, last: Column) -> Column:
            def block(i: Column) -> Column:
                b = F.when(i > 0, F.get(last, F.greatest(i - 1, F.lit(0)))).otherwise(0)
                near = F.slice(lines, F.greatest(b - 5, F.lit(1)), F.least(b, F.lit(6)))
                return F.filter(near, lambda x, j: F.forall(F.slice(near, j + 1, F.size(near)), lambda y: F.trim(y) != ""))

            return F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), x.alias("content"), F.when(x.rlike(f"(?i){PRIVILEGED.removeprefix('(?i)')}|{DESTRUCTIVE.removeprefix('(?i)')}"), F.concat(block(i), F.array(x))).alias("block")))

        return let(F.struct(lines.alias("lines"), last.alias("last")), lambda s: made(s["lines"], s["last"]))

    return let(F.split(text, "\r\n|\n|\r"), of)


def positive_actions(text: Column) -> Column:
    """array<struct<action, start, kind>>: disclosing actions that their clause does not negate."""
    clauses = F.split(text, CLAUSE_BREAK, -1)

    def kinds(action: Column, clause: Column) -> Column:
        low = F.lower(action)
        return F.array_compact(
            F.array(
                F.when(low.isin("console.log", "print", "logger", "log", "dump", "echo", "output", "cat"), "stdout-or-log"),
                F.when((low == "include") | (low.isin("attach", "load", "provide", "copy", "paste", "put", "send") & clause.rlike(PROMPT_WORD)), "prompt-or-context"),
                F.when(low.isin("upload", "attach", "send", "share", "post", "publish"), "external-upload"),
                F.when(low.isin("curl", "wget"), "network"),
            )
        )

    def of(clause: Column) -> Column:
        def positive(m: Column) -> Column:
            before = before16(clause, m["start"])
            return ~before.rlike(NEGATION) | let(F.concat(F.regexp_extract(before, rf"(?is).*({NEGATION.removeprefix('(?i)')}.*)\z", 1)), lambda tail: tail.rlike(DOUBLE_NEGATION))

        kept = F.filter(match_spans(clause, ACTION), positive)
        return F.flatten(F.transform(kept, lambda m: F.transform(kinds(m["text"], clause), lambda k: F.struct(F.lower(m["text"]).alias("action"), k.alias("kind")))))

    return F.when(text.rlike(ACTION), F.flatten(F.transform(clauses, of))).otherwise(F.array().cast("array<struct<action:string,kind:string>>"))


def _loose_installs(line: Column) -> Column:
    """Unpinned installs by words alone, where the command could not be read."""

    def words(pattern: str) -> Column:
        return F.filter(F.split(F.regexp_extract(line, pattern, 1), r"\s+"), lambda a: (a != "") & ~a.startswith("-") & ~a.rlike("[|;&]"))

    bare = lambda a: F.regexp_replace(a, r"""^(['"])(.*)\1\z""", "$2")
    mock = lambda a: a.rlike(r"(?i)^<.*>\z|^\[.*\]\z|^(example|placeholder|package|image)\z")
    npm = lambda a: let(bare(a), lambda x: ~(mock(x) | x.startswith(".") | x.rlike(r"^\$[A-Za-z_][A-Za-z0-9_]*\z")) & (npm_selector(x)["kind"] != "exact"))
    pip = lambda a: let(bare(a), lambda x: ~(mock(x) | x.startswith("-") | x.startswith(".")) & (python_selector(x)["kind"] != "exact"))
    image = F.regexp_extract(line, r"(?i)\bdocker\s+(?:pull|run)\s+([^\s#]+)", 1)
    tag = F.when(image.contains(":"), F.substring_index(image, ":", -1)).otherwise("")
    return (
        F.exists(words(r"(?i)\bnpm\s+(?:install|i|add)\s+([^\n#]+)"), npm)
        | F.exists(words(r"(?i)\bpnpm\s+(?:add|install)\s+([^\n#]+)"), npm)
        | F.exists(words(r"(?i)\byarn\s+(?:global\s+)?add\s+([^\n#]+)"), npm)
        | F.exists(words(r"(?i)\b(?:pip3?|(?:python(?:\d+(?:\.\d+)*)?|py)\s+-m\s+pip|uv\s+pip)\s+install\s+([^\n#]+)"), pip)
        | F.exists(words(r"(?i)\bbrew\s+install\s+([^\n#]+)"), lambda a: ~mock(a) & ~a.contains("/") & ~a.contains("@"))
        | ((image != "") & ~mock(image) & tag.isin("", "latest"))
    )


def _suppressed(line: Column, tokens: Column) -> Column:
    """Risky operations whose failure `|| true` or `|| :` hides."""
    at = lambda i: F.get(tokens, i)

    def risky(i: Column) -> Column:
        before = F.slice(tokens, F.lit(1), i)
        ends = F.filter(before, lambda t: (t["kind"] == "operator") & t["value"].isin(";", "|", "||", "&&", "&"))
        start = F.coalesce(F.try_element_at(ends, F.lit(-1))["end"], F.lit(0))
        operation = F.trim(F.substring(line, start + 1, at(i)["start"] - start))

        def of(op: Column) -> Column:
            direct = F.lower(F.regexp_extract(op, _EXECUTABLE + r"(?:\S*/)?([^\s/]+)", 1))
            deep = F.lower(F.regexp_extract(op, _EXECUTABLE + _SUDO + r"(?:\S*/)?([^\s/]+)", 1))
            destroys = deep.isin("docker", "drop", "git", "kubectl", "rm", "truncate") & op.rlike(DESTRUCTIVE)
            rules = direct.isin("chmod", "chown", "docker", "launchctl", "mount", "sudo", "systemctl") & op.rlike(PRIVILEGED)
            tells = ~(deep.isin("echo", "printf") & ~op.rlike(r"`|\$\(")) & op.rlike(CREDENTIAL_ANY)
            return destroys | rules | tells

        hides = (at(i)["kind"] == "operator") & (at(i)["value"] == "||") & F.coalesce((at(i + 1)["kind"] == "word") & at(i + 1)["value"].isin("true", ":"), F.lit(False))
        return F.when(hides, let(operation, of)).otherwise(False)

    n = F.size(tokens)
    return F.when(line.contains("||") & (n > 0), F.exists(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), risky)).otherwise(False)


def _disallowed(line: Column, names: Iterable[str]) -> Column:
    """The first disallowed command that a line uses: a plain word as a word, other text anywhere."""
    flat = F.lower(F.regexp_replace(line, r"\s+", " "))
    out = F.lit(None).cast("string")
    for name in reversed([" ".join(n.lower().split()) for n in names if n.strip()]):
        plain = all(c in "abcdefghijklmnopqrstuvwxyz0123456789_-" for c in name)
        out = F.when(flat.rlike(rf"(^|[^a-z0-9_-]){name}(\z|[^a-z0-9_-])") if plain else flat.contains(name), name).otherwise(out)
    return out


def may_concern(text: Column, policy: Policy) -> Column:
    """Whether any line of a text can concern a rule: one search that most texts fail, before they are cut into lines."""
    names = [r"\s+".join(rf"\Q{w}\E" for w in n.split()) for n in policy.disallowed if n.strip()]
    found = text.rlike(f"(?i){ANY_CONCERN}")
    return found | text.rlike(f"(?iu){'|'.join(names)}") if names else found


def scanned_lines(docs: DataFrame, doc: str, text: str, policy: Policy) -> DataFrame:
    """Lines that a rule can concern, with the facts that rules are made of."""
    c = F.col("content")
    texts = dealt(docs.where(may_concern(F.col(text), policy)).select(F.col(doc).alias("doc"), F.col(text).alias("text")), "doc")
    lines = texts.select("doc", F.explode(numbered_lines(F.col("text"))).alias("l")).select("doc", "l.*")
    names = [n for n in policy.disallowed if n.strip()]
    concern = c.rlike(f"(?i){MAY_CONCERN}")
    out = lines.where(concern | _disallowed(c, names).isNotNull() if names else concern)
    out = out.withColumn("tokens", shell_tokens(c)).withColumn("readable", F.col("tokens.supported")).withColumn("tokens", F.col("tokens.tokens"))
    out = out.withColumn("command", c.rlike(COMMAND_LIKE))
    none = F.lit(None).cast("struct<installs:array<struct<ecosystem:string,manager:string,package:string,reference:string,selector:string,selector_kind:string,pinning:string,variables:array<string>,allowed:boolean,start:int,end:int>>,is_install:boolean,npm_style:boolean,supported:boolean>")
    out = out.withColumn("installs", F.when(F.col("command"), commands.dependency_installs(F.col("tokens"), allowed=policy.allowed_floating)).otherwise(none))
    out = out.withColumn("sources", commands.sensitive_sources(c, F.col("tokens"))).withColumn("redirections", commands.redirections(F.col("tokens")))
    out = out.withColumn("actions", positive_actions(c))
    out = with_destinations(out)
    guard = lambda x: x.rlike(RECOVERY) | (x.rlike(APPROVAL) & ~x.rlike(WEAK_APPROVAL))
    out = out.withColumn("guarded", F.coalesce(F.exists("block", guard), F.lit(False)))
    out = out.withColumn("defensive", c.rlike(DEFENSIVE) & ~c.rlike(PERMISSIVE))
    return out.withColumn("refused", F.col("defensive") | c.rlike(GUARDED)).withColumn("disallowed", _disallowed(c, policy.disallowed))


def _rules(policy: Policy) -> dict[str, tuple[Column, Column, Column]]:
    """id -> (condition, key, severity)"""
    c, refused, command = F.col("content"), F.col("refused"), F.col("command")
    level = lambda i: F.lit(DEFINITIONS[i][0])
    kinds = F.transform("actions", lambda a: a["kind"])
    sinks = F.concat(kinds, F.transform("redirections", lambda r: r["kind"]), F.when(F.exists("upload", lambda x: x.isNotNull()), F.array(F.lit("external-upload"))).when(F.exists("network", lambda x: x.isNotNull()), F.array(F.lit("network"))).otherwise(F.array().cast("array<string>")))
    files = F.exists("sources", lambda s: s["kind"] != "environment-variable-api")
    tells = F.arrays_overlap(sinks, F.array(*map(F.lit, ("stdout-or-log", "prompt-or-context", "network", "external-upload"))))
    handled = ~tells & (F.size("actions") == 0) & c.rlike(SAFE_HANDLING)
    loose = F.exists("installs.installs", lambda i: ~i["allowed"] & i["pinning"].isin("unpinned", "floating-literal", "variable-unverified"))
    structured = F.coalesce(F.col("installs.is_install") & loose, F.lit(False))
    by_words = F.coalesce(~F.col("installs.is_install") | ~F.col("installs.supported") | ~F.col("readable"), F.lit(False)) & _loose_installs(c)
    url = F.regexp_replace(F.regexp_extract(c, REMOTE_SCRIPT, 2), r"[.,;:]+\z", "")
    aims = F.arrays_overlap(kinds, F.array(F.lit("network"), F.lit("external-upload")))
    quiet = (c.rlike(GUARDED) & ~c.rlike(WEAK_APPROVAL)) | (F.col("defensive") & ~aims)
    reaches = ~quiet & (~command | F.lit(policy.declared) | F.col("is_upload"))
    first_temp = F.regexp_extract(c, TEMP, 0)
    approved = [h.lower() for h in policy.approved]
    off_list = F.exists(F.arrays_zip(F.col("candidates").alias("c"), F.col("network").alias("a")), lambda x: x["a"].isNotNull() & x["c"]["host"].isNotNull() & ~F.exists(F.array(*map(F.lit, approved)), lambda h: (x["c"]["host"] == h) | (x["c"]["host"].contains(".") & h.contains(".") & ~x["c"]["host"].rlike(r"^[0-9.]+\z") & x["c"]["host"].endswith(F.concat(F.lit("."), h))))) if approved else F.lit(False)
    key = F.col("content")
    conditions = {
        "SEC-UNPINNED-REMOTE-SCRIPT": (command & c.rlike(REMOTE_SCRIPT) & ~c.rlike(PINNED_SCRIPT) & ~refused, url, None),
        "SEC-UNPINNED-DEPENDENCY-INSTALL": (command & (structured | by_words) & ~refused, key, None),
        "SEC-RISKY-OPERATION-ERROR-SUPPRESSION": (command & F.col("readable") & ~refused & _suppressed(c, F.col("tokens")), F.col("line").cast("string"), None),
        "SEC-PRIVILEGED-COMMAND-WITHOUT-GUARD": (command & c.rlike(PRIVILEGED) & ~F.col("guarded") & ~refused, key, None),
        "SEC-DESTRUCTIVE-COMMAND": (command & c.rlike(DESTRUCTIVE) & ~F.col("guarded") & ~refused, key, None),
        "SEC-CREDENTIAL-IN-COMMAND-ARG": (command & c.rlike(CREDENTIAL), key, None),
        "SEC-PREDICTABLE-TEMP-PATH": ((first_temp != "") & ~c.rlike(DESTRUCTIVE) & ~c.rlike(NOT_PREDICTABLE), F.concat_ws(":", first_temp, F.floor((F.col("line") - 1) / 10)), F.when(c.rlike(SENSITIVE_TEMP), "medium").otherwise("low")),
        "SEC-DANGEROUS-TOOL-INSTRUCTION": (F.col("disallowed").isNotNull(), F.concat_ws(":", "disallowed", "line"), None),
        "SEC-EXTERNAL-UPLOAD-INSTRUCTION": (reaches & F.col("is_upload"), key, F.lit("high" if policy.upload_allowed is False else "medium")),
        "SEC-BULK-DATA-SHARING-INSTRUCTION": (reaches & c.rlike(BULK_SOURCE) & c.rlike(DISCLOSES), key, None),
        "SEC-CLOUD-UPLOAD-INSTRUCTION": (reaches & (c.rlike(CLOUD_UPLOAD) | c.rlike(CLOUD)), key, None),
        "SEC-OVERBROAD-CONTEXT-INSTRUCTION": (c.rlike(OVERBROAD) & ~F.col("defensive"), key, None),
        "SEC-NO-REDACTION-INSTRUCTION": ((c.rlike(NO_REDACTION) | (c.rlike(UNREDACTED) & c.rlike(DISCLOSES))) & ~F.col("defensive"), key, None),
        "SEC-SENSITIVE-FILE-REFERENCE": (files & ~handled, key, None),
        "SEC-SECRET-MATERIAL-INSTRUCTION": ((c.rlike(SECRET_ACTION) | tells) & (c.rlike(SECRET_WORD) | files) & ~handled, key, F.lit("critical" if policy.secrets_allowed is False or policy.upload_allowed else "high")),
        "SEC-UNAPPROVED-NETWORK-DESTINATION": (off_list & ~quiet, key, None),
    }
    return {i: (condition, k, level(i) if severity is None else severity) for i, (condition, k, severity) in conditions.items()}


def security_findings(docs: DataFrame, doc: str = "doc_id", text: str = "text", policy: Policy = Policy()) -> DataFrame:
    """(doc, line, rule_id, severity, confidence, risk_class, snippet); a rule's key counts once in a document."""
    rows = scanned_lines(docs, doc, text, policy)
    found = [
        F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(i).alias("rule_id"), severity.alias("severity"), F.lit(DEFINITIONS[i][1]).alias("confidence"), F.lit(DEFINITIONS[i][2]).alias("risk_class"), F.xxhash64(key).alias("key")))
        for i, (condition, key, severity) in _rules(policy).items()
    ]
    flat = rows.select("doc", "line", F.explode(F.array_compact(F.array(*found))).alias("f"), F.substring(F.trim("content"), 1, 600).alias("snippet")).select("doc", "line", "f.*", "snippet")
    first = Window.partitionBy("doc", "rule_id", "key").orderBy("line")
    return flat.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "key")
