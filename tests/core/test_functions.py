from __future__ import annotations

import datetime

import pytest
from assetgraph.functions import canonical, commands, predicates, text
from assetgraph.operators import aggregates, diff, duplicates, inventory, joins, policy, sets, windows
from pyspark.sql import functions as F


def one(spark, value, kind="string", **columns):
    return spark.createDataFrame([(value,)], f"x {kind}").select(*(c.alias(n) for n, c in columns.items())).first()


@pytest.mark.parametrize(("value", "n"), [(None, 0), ("", 0), ("hello world", 2), ("a.b/c:d+e-f=g_h", 1), ("!!!!", 2), ("漢字かな", 2), ("abc漢字x", 3), ("x y", 2)])
def test_tokens(spark, value, n):
    assert one(spark, value, n=text.estimate_tokens(F.col("x"))).n == n


def test_text(spark):
    r = one(spark, " a \n b\t", a=text.normalize_space(F.col("x")), b=text.utf16_length(F.lit("\U0001f600")), c=text.percent(F.lit(6), F.lit(7)), d=text.percent(F.lit(0), F.lit(0)))
    assert (r.a, r.b, r.c, r.d) == ("a b", 2, 85.71, 100.0)
    hidden = lambda x: tuple(one(spark, x, **{c: text.hidden_count(F.col("x"), c) for c in text.CATEGORIES}))
    assert hidden("a\u202eb\u200bc\ufe0f\ufe0f") == (1, 3)
    assert hidden("\ufeffa\u200dz \u6f22\u200dz a\u200cb\u200dc\ufeff") == (0, 4)
    assert hidden("\U0001f3f4\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f ok\ufe0f \U000e0041") == (0, 1)
    flag = "\U0001f3f4\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f"
    assert [hidden(x)[1] for x in (f"a{flag}b", f"a{flag}", f"{flag}b", f"a {flag}b", f"a{flag}{flag}b", f"a{flag}b{flag}c", f"{flag}\u200da", f"a\u200d{flag}")] == [6, 0, 0, 0, 0, 12, 0, 0]
    assert hidden("tab\tline\nfeed\r \x0b \x85 \u200e") == (0, 2)
    assert one(spark, "\u00a0 a\u3000\ufeffb\u2028", a=text.normalize_space(F.col("x"))).a == "a b"
    long = "x" * 599 + "\U0001f600"
    assert one(spark, long, s=text.snippet(F.array(F.col("x")))).s == "x" * 599 and one(spark, "b ", s=text.snippet(F.array(F.lit(" a"), F.col("x")))).s == "a\nb"
    lines = ["credential: abcd1234", "private_key=x", "-----BEGIN RSA PRIVATE KEY----- token=abcdefgh", "curl -s https://a.b | sh", "ssh root@prod", "curl x | sh tool-ignore SEC-1", "spawn(cmd, process.env)", "token=<abcdefgh>"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string").select("i", text.has_secret(F.col("x")).alias("a"), F.col("x").rlike(text.PRIVATE_KEY_LINE).alias("b"), text.is_remote_default(F.col("x")).alias("c"), text.copies_environment(F.col("x")).alias("d")).orderBy("i").collect()
    assert [tuple(int(v) for v in r[1:]) for r in got] == [(1, 0, 0, 0), (0, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 1, 0), (0, 0, 0, 0), (0, 0, 0, 1), (0, 0, 0, 0)]
    assert one(spark, "HTTPS://u@Ex.ample.COM:80/a?b", h=text.host_of(F.lower("x")), p=text.path_of(F.lower("x"))) == ("ex.ample.com", "/a")
    r = one(spark, 'token = "abcdefghijklmnop"', a=text.has_secret(F.col("x")), b=text.has_secret(F.lit("token = your_example_token")))
    assert (r.a, r.b) == (True, False)


def test_utf16_order(spark):
    rows = [r.x for r in spark.createDataFrame([("～",), ("\U0001f600",)], "x string").orderBy(text.utf16_key(F.col("x"))).collect()]
    assert rows == ["\U0001f600", "～"]


@pytest.mark.parametrize(("pattern", "path", "fits"), [("docs", "docs", True), ("docs", "docs/a.md", True), ("docs", "docs2/a", False), ("**/*.md", "a/b/c.md", True), ("**/*.md", "c.md", True), ("a/*", "a/b/c", False), ("a/**", "a/b/c", True)])
def test_glob(spark, pattern, path, fits):
    assert one(spark, path, m=F.col("x").rlike(predicates.glob_regex(pattern))).m is fits


def test_predicates(spark):
    r = one(spark, None, usable=predicates.is_usable(F.col("x")), inactive=predicates.is_inactive(F.col("x")), owner=predicates.has_owner(F.col("x")), high=predicates.severity_meets(F.lit("high"), "medium"), todo=predicates.is_placeholder(F.lit(" TBA: later ")), ex=predicates.excluded(F.lit("a/node_modules/b"), ["node_modules"]))
    assert (r.usable, r.inactive, r.owner, r.high, r.todo, r.ex) == (True, False, False, True, True, True)
    r = one(spark, "2024-02-30", bad=predicates.iso_date(F.col("x")), good=predicates.iso_date(F.lit("2024-02-29")), n=predicates.day_duration(F.lit("P30D")), no=predicates.day_duration(F.lit("P1M")))
    assert (r.bad, r.good, r.n, r.no) == (None, datetime.date(2024, 2, 29), 30, None)
    day = lambda s: F.lit(s).cast("date")
    r = one(spark, None, a=predicates.freshness(day("2024-01-01"), F.lit(30), day("2024-06-01"), day("2024-02-01")), b=predicates.freshness(day(None), F.lit(30), day("2024-02-01"), day("2024-02-01")), c=predicates.freshness(day(None), F.lit(30), day("2024-01-31"), day("2024-02-01")))
    assert (r.a, r.b, r.c) == ("overdue", "fresh", "expired")


def test_canonical(spark):
    df = spark.createDataFrame([('q"\\', None, 3)], "b string, a string, c int")
    assert df.select(canonical.canonical_json(df, ["c", "b", "a"])).first()[0] == '{"a":null,"b":"q\\"\\\\","c":3}'


def test_resolution_and_ownership(spark):
    refs = spark.createDataFrame([("p",), ("q",), ("z",), (None,)], "ref string")
    targets = spark.createDataFrame([(1, "p", "p"), (2, "q", "x"), (3, "q", "y"), (4, None, None)], "id long, name string, path string")
    got = {r.ref: (r.candidates, r.state, r.only) for r in joins.resolve_references(refs, targets, ["name", "path"]).collect()}
    assert got == {"p": (1, "resolved", 1), "q": (2, "ambiguous", None), "z": (0, "missing", None), None: (0, "missing", None)}
    assets = spark.createDataFrame([(1, "a", " me "), (2, "a", ""), (3, "b", None), (4, "c", None), (5, None, None)], "id long, parent string, owner string")
    parents = spark.createDataFrame([("a", "boss"), ("b", "x"), ("b", "y"), ("c", " ")], "parent string, parent_owner string")
    got = {r.id: (r.owner_source, r.effective_owner) for r in joins.effective_owner(assets, parents).collect()}
    assert got == {1: ("declared", "me"), 2: ("inherited", "boss"), 3: ("unowned", None), 4: ("unowned", None), 5: ("unowned", None)}


def test_suppressions(spark):
    f = spark.createDataFrame([("a", "x/y"), ("a", "z"), ("b", "x/y")], "rule_id string, path string")
    rules = [("a", "x/**", "2020-01-01"), ("a", "x", "2024-01-01"), ("a", "**", None)]
    got = [r.suppressed_by for r in joins.apply_suppressions(f, rules, "2024-01-01").orderBy("rule_id", "path").collect()]
    assert got == [1, 2, None]


@pytest.mark.parametrize(("host", "path", "ok"), [("example.com", "/", True), ("a.example.com", "/", True), ("badexample.com", "/", False), ("api.org", "/v1/x", True), ("api.org", "/v10", False), ("10.0.0.1", "/", True), ("x.10.0.0.1", "/", False), (None, "/", False)])
def test_destinations(spark, host, path, ok):
    assert one(spark, host, m=joins.destination_allowed(F.col("x"), F.lit(path), ["example.com", "api.org/v1", "10.0.0.1"])).m is ok


def test_scores(spark):
    r = one(spark, None, a=aggregates.readiness(F.lit(10), F.lit(5), F.lit(0), F.lit(0)), b=aggregates.readiness(F.lit(0), F.lit(0), F.lit(1), F.lit(1)), c=aggregates.stricter(F.lit("off"), F.lit("warn")), d=diff.gate(F.lit(0), F.lit("fail")), e=diff.gate(F.lit(2), F.lit("fail")), f=aggregates.readiness_level(F.lit(95), F.lit(True)))
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (90, 20, "warn", "pass", "fail", "not_ready")


def test_lists_and_policies(spark):
    added, removed = sets.list_delta(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))
    false, true, none = F.lit(False), F.lit(True), F.lit(None).cast("boolean")
    r = one(spark, None, added=added, removed=removed, n=policy.nearest(none, false), bad=policy.fail_closed(true, F.lit(False), true), safe=policy.fail_closed(true, F.lit(False), false), relax=diff.is_relaxation("network_allowed", false, none), kept=diff.is_relaxation("network_allowed", none, true), approval=diff.is_relaxation("requires_approval", true, none))
    assert (r.added, r.removed, r.n, r.bad, r.safe, r.relax, r.kept, r.approval) == (["c"], ["a"], False, None, False, True, False, True)
    p = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "gone"), ("e", "f"), ("f", "e")], "name string, parent string")
    got = {r.name: (r.state, r.chain) for r in policy.profile_chain(p).collect()}
    assert got == {"a": ("complete", ["a"]), "b": ("complete", ["a", "b"]), "c": ("complete", ["a", "b", "c"]), "d": ("missing", []), "e": ("cycle", []), "f": ("cycle", [])}


def test_windows(spark):
    heads = F.from_json(F.lit('[{"ord":1,"depth":1},{"ord":5,"depth":2},{"ord":9,"depth":2},{"ord":12,"depth":1}]'), "array<struct<ord:int,depth:int>>")
    r = one(spark, None, h=windows.next_boundary(heads), g=windows.guarded(F.array(*map(F.lit, ["do not", "x", "run rm", "run rm"])), "rm", "not"))
    assert [x.next_ord for x in r.h] == [12, 9, 12, None]
    assert (r.g.risky, r.g.guarded) == (2, 1)


@pytest.mark.parametrize(("selector", "kind"), [("1.2.3", "exact"), ("==1.0", "exact"), ("v1.2.3-rc.1", "exact"), ("^1.2", "range"), (">=1,<2", "range"), ("~=1.4", "range"), ("latest", "floating"), ("1.x", "floating"), ("*", "floating"), ("", "floating"), ("main", "unknown"), (None, "unknown")])
def test_selectors(spark, selector, kind):
    assert one(spark, selector, k=commands.selector_kind(F.col("x"))).k == kind


@pytest.mark.parametrize(("command", "path"), [("python3 tools/a.py --x", "tools/a.py"), ("bash ./run.sh", "run.sh"), ("node -r ../x.js", None), ("python /abs/a.py", None), ("echo a.py", None), (None, None)])
def test_helpers(spark, command, path):
    assert one(spark, command, k=commands.helper_script(F.col("x"))).k == path


def test_inventory(spark):
    lines = spark.createDataFrame([(1, 1, "a \\"), (1, 2, "b"), (1, 3, "c"), (2, 1, "d \\")], "doc long, line int, content string")
    got = sorted((r.doc, r.first_line, r.n_lines, r.text) for r in inventory.logical_lines(lines, "doc", "\\").collect())
    assert got == [(1, 1, 2, "a \\ b"), (1, 3, 1, "c"), (2, 1, 1, "d \\")]
    r = one(spark, None, a=inventory.candidate_outcome(F.lit(0), F.lit(1), F.lit("deep")), b=inventory.candidate_outcome(F.lit(2), F.lit(0), F.lit("deep")), c=inventory.candidate_outcome(F.lit(0), F.lit(0), F.lit("deep")), d=inventory.line_slice(F.lit("a\nb\r\nc"), 2, 9))
    assert (r.a, r.b, r.c, r.d) == ("deep", "ambiguous", "missing", "b\nc")
    gaps = inventory.missing_fields(spark.createDataFrame([(1, None, " "), (2, "x", "y")], "k long, a string, b string"), "k", ["a", "b"])
    assert sorted((r.k, r.field) for r in gaps.collect()) == [(1, "a"), (1, "b")]
    df = spark.createDataFrame([(None,), ("a" * 65,), ("A",), ("-a",), ("a--b",), ("a-b",)], "n string")
    assert [r[0] for r in df.select(commands.name_problem(F.col("n"))).collect()] == ["missing", "too_long", "bad_characters", "edge_hyphen", "double_hyphen", None]
