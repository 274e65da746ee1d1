"""Paths of a repository: normal form and the kind of asset that a path stands for, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import let

# Roots of skills, and the folders below a skill with the kind of what they hold.
SUPPORT_KINDS = {"assets": "asset", "examples": "example", "profiles": "profile", "references": "reference", "scripts": "script"}
GENERIC = ("profiles", "references", "examples")  # read as such outside a skill too
CONFIG_NAMES = ("assetgraph.config.json", "assetgraph.config.jsonc")


def normal_path(path: Column) -> Column:
    """A relative path with / and without empty and . segments; null if it is absolute, empty or holds a .. segment."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.split(p, "/")
    kept = F.array_join(F.filter(parts, lambda s: (s != "") & (s != ".")), "/")
    return F.when(~p.startswith("/") & ~p.rlike("^[A-Za-z]:/") & ~F.array_contains(parts, "..") & (kept != ""), kept)


def _answer(kind: Column | str, scope: str, rule: Column | str, reason: str, root: Column | str | None = None, parent: Column | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(lit(kind).alias("kind"), F.lit(scope).alias("scope"), lit(rule).alias("rule"), F.lit(reason).alias("reason"), lit(root).alias("root"), lit(parent).alias("parent"))


def classify_path(path: Column, metadata_type: Column | None = None, config_names: Iterable[str] = CONFIG_NAMES) -> Column:
    """struct<kind, scope, rule, reason, root, parent>: the first rule that fits a path.

    A skill's entry file; support of a skill; a support folder at a skill root itself; tools below a skill root; contexts, lenses, agents; repository
    tools; configuration; support-like folders elsewhere; unknown.  metadata_type makes a context a lens.
    """
    outside = "outside-recognized-asset-boundary"

    def answer(p: Column, s: Column, deep: Column) -> Column:
        root = F.when(deep == 2, ".agents/skills").when(deep == 1, "skills")
        local = F.slice(s, deep + 1, F.size(s))
        at = F.array_min(F.filter(F.transform(F.array(*map(F.lit, SUPPORT_KINDS)), lambda d: F.array_position(local, d)), lambda i: i > 0))
        folder = F.get(local, (at - 1).cast("int"))
        kind = F.create_map(*(F.lit(x) for kv in SUPPORT_KINDS.items() for x in kv))[folder]
        generic = folder.isin(*GENERIC)
        skill = F.concat(F.array_join(F.slice(s, F.lit(1), deep + at.cast("int") - 1), "/"), F.lit("/SKILL.md"))
        first, inner = F.get(s, F.lit(0)), F.slice(s, F.lit(2), F.greatest(F.size(s) - 2, F.lit(0)))
        lens = F.coalesce(metadata_type == "context_lens", F.lit(False)) if metadata_type is not None else F.lit(False)
        out = (
            F.when(p.isNull(), _answer("unknown", "unknown", "unknown", outside))
            .when((deep > 0) & at.isNull() & (F.element_at(s, -1) == "SKILL.md") & (F.size(local) > 1), _answer("skill", "independent", "skill-entrypoint", "under-canonical-skill-root", root))
            .when((deep > 0) & (at > 1), _answer(kind, "skill-local", "skill-local-support", "under-skill-support-directory", root, skill))
            .when((deep > 0) & (at == 1), _answer(F.when(generic, kind).otherwise("unknown"), "unknown", F.when(generic, F.concat(F.lit("generic-"), kind)).otherwise("unknown"), outside, root))
            .when((deep > 0) & F.array_contains(local, "tools"), _answer("unknown", "repository-support", "unknown", "unsupported-skill-local-directory", root))
            .when(first == "context", _answer("unknown", "unknown", "unknown", outside))
            .when(first == "contexts", _answer(F.when(lens, "context_lens").otherwise("context"), "independent", "context-root", "under-recognized-context-root", "contexts"))
            .when(first == "lenses", _answer("context_lens", "independent", "lens-root", "under-recognized-lens-root", "lenses"))
            .when((p == "AGENTS.md") | (first == ".agents"), _answer("agent", "independent", "agent-root", "under-recognized-agent-root", F.when(p == "AGENTS.md", "AGENTS.md").otherwise(".agents")))
            .when(first == "tools", _answer("unknown", "repository-support", "repository-tool", "repository-tool-not-context", "tools"))
            .when(F.element_at(s, -1).isin(*config_names), _answer("config", "repository-support", "config-file", "recognized-config-file"))
        )
        for name in GENERIC:
            out = out.when(F.array_contains(inner, name), _answer(SUPPORT_KINDS[name], "unknown", f"generic-{SUPPORT_KINDS[name]}", "under-generic-support-directory"))
        return out.otherwise(_answer("unknown", "unknown", "unknown", outside))

    def depth(p: Column, s: Column) -> Column:
        return F.when((F.get(s, F.lit(0)) == ".agents") & (F.coalesce(F.get(s, F.lit(1)), F.lit("")) == "skills"), 2).when(F.get(s, F.lit(0)) == "skills", 1).otherwise(0)

    return let(normal_path(path), lambda p: F.split(F.coalesce(p, F.lit("")), "/"), depth, answer)
