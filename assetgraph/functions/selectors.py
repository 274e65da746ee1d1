"""Version selectors of npm and Python requirements, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import let

# What the two ecosystems accept as names, versions and references.
_DIRECT = r"(?i)^(?:https?:|git(?:\+[A-Za-z]+)?:|git@|github:|gitlab:|bitbucket:|npm:|file:|link:|workspace:)|^(?:\.{0,2}/|/|~/)|\.(?:tgz|tar\.gz|whl|zip)(?:[#?].*)?\z"
_NPM_NAME = r"^(?:@[A-Za-z0-9._~-]+/)?[A-Za-z0-9._~-]+\z"
_PRE = r"(?:0|[1-9]\d*|[0-9A-Za-z-]*[A-Za-z-][0-9A-Za-z-]*)"
_NPM_EXACT = rf"^(?:v|=)?(?:0|[1-9]\d*)\.(?:0|[1-9]\d*)\.(?:0|[1-9]\d*)(?:-{_PRE}(?:\.{_PRE})*)?(?:\+[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?\z"
_PY_NAME = r"^[A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?"
_PY_EXTRAS = r"^[ \t]*\[([^\]]*)\]"
_PY_VERSION = r"(?i)^v?(?:\d+!)?\d+(?:\.\d+)*(?:[._-]?(?:a|b|c|rc|alpha|beta|pre|preview)[._-]?\d*)?(?:(?:-\d+)|(?:[._-]?(?:post|rev|r)[._-]?\d*))?(?:[._-]?dev[._-]?\d*)?(?:\+[0-9A-Za-z]+(?:[._-][0-9A-Za-z]+)*)?\z"
_PY_PREFIX = r"(?i)^v?(?:\d+!)?\d+(?:\.\d+)*\z"
_COMPARE = r"(?:===|==|~=|!=|<=|>=|<|>)"
_CLAUSE = rf"[ \t]*{_COMPARE}[ \t]*[^\s,]+[ \t]*"

SELECTOR_TYPE = "struct<ecosystem:string,package:string,normalized_package:string,reference:string,selector:string,normalized_selector:string,kind:string,normalized_reference:string>"


def _struct(ecosystem: str, package: Column, normal: Column, reference: Column, selector: Column, normal_selector: Column, kind: Column, normal_reference: Column) -> Column:
    names = ("package", "normalized_package", "reference", "selector", "normalized_selector", "kind", "normalized_reference")
    return F.struct(F.lit(ecosystem).alias("ecosystem"), *(c.cast("string").alias(n) for c, n in zip((package, normal, reference, selector, normal_selector, kind, normal_reference), names)))


def _plain(ecosystem: str, reference: Column, kind: Column) -> Column:
    none = F.lit(None)
    return _struct(ecosystem, none, none, reference, reference, reference, kind, reference)


def npm_selector_kind(s: Column) -> Column:
    return (
        F.when(s == "", "bare")
        .when(s.contains("$"), "variable")
        .when(s.rlike(_DIRECT), "direct-reference")
        .when(s.rlike(_NPM_EXACT), "exact")
        .when(s.contains("*") | s.rlike(r"(?:^|[.\s-])[xX](?:\z|[.\s-])"), "wildcard")
        .when(s.rlike(r"^v?\d+(?:\.\d+)?\z") | s.rlike(r"^(?:[~^]|[<>]=?|=)|\|\||\s+-\s|\s"), "range")
        .when(s.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*\z"), "dist-tag")
        .otherwise("unknown")
    )


def npm_selector(reference: Column) -> Column:
    """name, name@selector or name with a comparator; scoped names too."""

    def package(r: Column) -> Column:
        scoped = F.regexp_extract(r, r"^(@[^/]+/[^@]*)(?:@([\s\S]*))?\z", 1)
        at = F.regexp_extract(r, r"^([^@]+)@", 1)
        compared = F.regexp_extract(r, r"^([^@<>=~^]+)[<>=~^]", 1)
        return F.when(r.startswith("@"), scoped).when(at != "", at).when(r.contains("@"), "").when(compared != "", compared).otherwise(r)

    def with_at(r: Column, name: Column) -> Column:
        return F.substring(r, F.length(name) + 1, F.lit(1)) == "@"

    def selector(r: Column, name: Column, has_at: Column) -> Column:
        return F.substring(r, F.length(name) + F.when(has_at, 2).otherwise(1), F.length(r))

    def result(r: Column, name: Column, has_at: Column, s: Column) -> Column:
        joined = F.when(s == "", F.lower(name)).otherwise(F.concat(F.lower(name), F.when(has_at, "@").otherwise(""), s))
        known = _struct("npm", name, F.lower(name), r, s, s, npm_selector_kind(s), joined)
        return F.when(name.rlike(_NPM_NAME), known).otherwise(_plain("npm", r, F.when(r.rlike(_DIRECT), "direct-reference").otherwise("unknown")))

    return let(reference, package, with_at, selector, result)


def python_selector_kind(s: Column) -> Column:
    after = lambda mark: F.substring(s, len(mark) + 1, F.length(s))
    stem = lambda mark: F.regexp_replace(after(mark), r"\.\*\z", "")
    star = F.when(stem("==").rlike(_PY_PREFIX), "wildcard").otherwise("unknown")
    return (
        F.when(s == "", "bare")
        .when(s.contains("$"), "variable")
        .when(s.rlike(r"^\s*@") | s.contains(";") | s.rlike(_DIRECT), "direct-reference")
        .when(s.rlike(rf"^{_COMPARE}[^\s,]+(?:,{_COMPARE}[^\s,]+)+\z"), "range")
        .when(s.rlike(r"^===[^\s,;]+\z"), "exact")
        .when(s.rlike(r"^==.+\.\*\z"), star)
        .when(s.rlike(r"^==.+\z"), F.when(after("==").rlike(_PY_VERSION), "exact").otherwise("unknown"))
        .when(s.rlike(r"^!=.+\.\*\z"), star)
        .when(s.contains("*"), "unknown")
        .when(s.rlike(r"^(?:~=|!=|<=|>=|<|>)[^\s,]+\z"), "range")
        .otherwise("unknown")
    )


def python_selector(reference: Column) -> Column:
    """A requirement: name, extras and specifiers, which are normalised."""

    def selector(r: Column, package: Column, rest: Column, bracket: Column) -> Column:
        return F.when(bracket, F.regexp_replace(rest, _PY_EXTRAS, "")).otherwise(rest)

    def extras(r: Column, package: Column, rest: Column, *_: Column) -> Column:
        return F.transform(F.split(F.regexp_extract(rest, _PY_EXTRAS, 1), ","), lambda e: F.regexp_replace(e, r"^[ \t]+|[ \t]+\z", ""))

    def normal(r: Column, package: Column, rest: Column, bracket: Column, s: Column, _: Column) -> Column:
        trimmed = F.regexp_replace(s, r"^[ \t]+|[ \t]+\z", "")
        listed = ~trimmed.startswith("@") & ~trimmed.contains(";") & s.rlike(rf"^{_CLAUSE}(?:,{_CLAUSE})*\z")
        return F.when(trimmed == "", "").when(listed, F.regexp_replace(s, r"[ \t]+", "")).otherwise(s)

    def result(r: Column, package: Column, rest: Column, bracket: Column, s: Column, extra: Column, norm: Column) -> Column:
        name = F.regexp_replace(F.lower(package), r"[-_.]+", "-")
        shown = F.concat(name, F.when(bracket, F.concat(F.lit("["), F.array_join(F.transform(extra, F.lower), ","), F.lit("]"))).otherwise(""), norm)
        known = _struct("pypi", package, name, r, s, norm, python_selector_kind(norm), shown)
        odd = _plain("pypi", r, F.when(r.contains("$"), "variable").otherwise("unknown"))
        bad = bracket & ~(rest.rlike(_PY_EXTRAS) & F.forall(extra, lambda e: e.rlike(_PY_NAME + r"\z")))
        return F.when(r.rlike(_DIRECT), _plain("pypi", r, F.lit("direct-reference"))).when((package == "") | bad, odd).otherwise(known)

    return let(
        reference,
        lambda r: F.regexp_extract(r, _PY_NAME, 0),
        lambda r, package: F.substring(r, F.length(package) + 1, F.length(r)),
        lambda r, package, rest: rest.rlike(r"^[ \t]*\["),
        selector,
        extras,
        normal,
        result,
    )
