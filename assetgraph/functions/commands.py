"""Version selectors, helper commands and names, by pattern."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Launchers of helper scripts.
LAUNCHERS = ("node", "bash", "sh", "python", "python3", "pwsh", "pwsh.exe", "powershell", "powershell.exe", "cmd", "cmd.exe")


def selector_kind(selector: Column) -> Column:
    """How tightly a version selector pins: exact, range, floating or unknown."""
    s = F.trim(selector)
    exact = s.rlike(r"^(==?)?v?\d+(\.\d+){1,3}(-[0-9A-Za-z.-]+)?$")
    floating = s.rlike(r"^(latest|next|\*|x|v?\d+(\.(x|\*))+|v?\d+\.\d+\.(x|\*))$") | (s == "")
    ranged = s.rlike(r"^([\^~]|[<>]=?|~=|!=)\s*v?\d") | s.rlike(r"\d\s*(,|\|\||\s-\s)")
    return F.when(s.isNull(), "unknown").when(exact, "exact").when(floating, "floating").when(ranged, "range").otherwise("unknown")


def helper_script(command: Column) -> Column:
    """The script path that a launcher is given first; null if the command is none, or the path is absolute or leaves the tree."""
    path = F.regexp_extract(command, rf"^\s*(?:{'|'.join(x.replace('.', '[.]') for x in LAUNCHERS)})\s+(?:-[A-Za-z-]+\s+)*(?:\./)?([A-Za-z0-9_][A-Za-z0-9_./-]*\.[A-Za-z0-9]+)(?:\s|$)", 1)
    return F.when((path != "") & ~path.contains(".."), path)


def name_problem(name: Column) -> Column:
    """The first rule that an asset name breaks, or null: missing, too_long, bad_characters, edge_hyphen, double_hyphen."""
    n = F.trim(name)
    return (
        F.when(n.isNull() | (n == ""), "missing")
        .when(F.length(n) > 64, "too_long")
        .when(~n.rlike("^[a-z0-9-]+$"), "bad_characters")
        .when(n.startswith("-") | n.endswith("-"), "edge_hyphen")
        .when(n.contains("--"), "double_hyphen")
    )


def script_share(text: Column) -> Column:
    """latin, cjk, other or none: the commonest class of letters (ties: latin, then cjk)."""
    latin, cjk, letters = (F.regexp_count(text, F.lit(p)) for p in (r"\p{IsLatin}", r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]", r"\p{L}"))
    other = letters - latin - cjk
    return F.when(letters == 0, "none").when((latin >= cjk) & (latin >= other), "latin").when(cjk >= other, "cjk").otherwise("other")
