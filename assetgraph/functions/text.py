"""Scalar text functions, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Character classes of the token estimate.
_CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
_BLANK = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
TOKEN = (
    rf"[{_CJK}]{{1,2}}"
    rf"|(?![{_CJK}])[\p{{L}}\p{{N}}_](?:(?![{_CJK}])[\p{{L}}\p{{N}}_./:+\-=])*"
    rf"|(?:(?![{_CJK}])[^{_BLANK}\p{{L}}\p{{N}}_]){{1,3}}"
)

# Hidden characters by category.
BIDI = r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]"
# controls, tags, and named characters
INVISIBLE = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{E0000}-\x{E007F}\x{00AD}\x{034F}\x{200B}\x{2060}\x{206A}-\x{206F}\x{FEFF}\x{FFF9}-\x{FFFB}]"
VARIATION_RUN = r"[\x{180B}-\x{180D}\x{180F}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]{2,}"
JOINERS = r"[\x{200C}\x{200D}]"  # hidden only between two of:
ASCII_TOKEN = r"[A-Za-z0-9_.\-/:@%+=]"
# the three regional flags that are written with tags: gbeng, gbsct, gbwls
FLAGS = r"\x{1F3F4}\x{E0067}\x{E0062}(?:\x{E0065}\x{E006E}\x{E0067}|\x{E0073}\x{E0063}\x{E0074}|\x{E0077}\x{E006C}\x{E0073})\x{E007F}"
CATEGORIES = ("bidi_control", "invisible_character")

# Characters that a reader does not see, by code points, taken out before identifiers are compared.
IGNORABLE = (
    r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}-\x{9F}\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}"
    r"\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{E0000}\x{E0001}\x{E0020}-\x{E007F}\x{E0100}-\x{E01EF}]"
)

# Lines with a literal secret, a private key, an unsafe remote command, an environment that is passed on; and what excuses them.
SECRET_LINE = r"(?i)\b(?:password|passwd|token|api[_-]?key|secret|credential|private[_-]?key)\b\s*[:=]\s*[\"']?([A-Za-z0-9_./+=-]{8,})"
PLACEHOLDER = r"(?i)(?:example|placeholder|your_|<[^>]+>|\$\{[^}]+})"
PRIVATE_KEY_LINE = r"-----BEGIN (?:RSA |OPENSSH |EC |DSA )?PRIVATE KEY-----"
REMOTE_LINE = r"(?i)\b(?:curl|wget)\b.*(?:\|\s*(?:sh|bash)|\b(?:example\.com|prod|production|--insecure|-k)\b)|\b(?:ssh|scp)\b.*\b(?:example\.com|prod|production|root@|--insecure|-k|StrictHostKeyChecking=no|UserKnownHostsFile=/dev/null)\b"
ENV_COPY_LINE = r"(?i)\b(?:process\.env|env)\b.*\b(?:spawn|exec|execFile|system|subprocess|child_process)\b|\b(?:spawn|exec|execFile|system|subprocess|child_process)\b.*\b(?:process\.env|env)\b"
IGNORED_LINE = r"tool-ignore\s+[A-Z0-9-]+"


def estimate_tokens(text: Column) -> Column:
    """Token estimate: pairs of CJK characters, word runs, and runs of up to three other marks; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def trim_space(text: Column) -> Column:
    """Without blanks at the ends; blanks are those of the token estimate, not ASCII ones only."""
    return F.regexp_replace(text, rf"^[{_BLANK}]+|[{_BLANK}]+$", "")


def normalize_space(text: Column) -> Column:
    """Runs of blanks become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, rf"[{_BLANK}]+", " "))


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def utf16_key(text: Column) -> Column:
    """A sort key that orders strings by UTF-16 code units."""
    return F.encode(text, "UTF-16BE")


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def cut_utf16(text: Column, most: int) -> Column:
    """The first `most` UTF-16 units; a pair that would be cut in two is left out whole."""
    units = F.encode(text, "UTF-16BE")
    last = F.hex(F.substring(units, 2 * most - 1, 1))
    return F.decode(F.when(last.between("D8", "DB"), F.substring(units, 1, 2 * most - 2)).otherwise(F.substring(units, 1, 2 * most)), "UTF-16BE")


def snippet(lines: Column, most: int = 600) -> Column:
    """An array of lines, joined, trimmed and cut."""
    return cut_utf16(trim_space(F.array_join(lines, "\n")), most)


def _cleaned(text: Column, begins: Column) -> Column:
    """With allowed flags as their first character alone, and without a byte order mark where the file begins.

    A flag is allowed unless it stands between two characters of one token.
    """
    text = F.regexp_replace(text, f"(?<!{ASCII_TOKEN}){FLAGS}|{FLAGS}(?!{ASCII_TOKEN})", "\U0001f3f4")
    return F.when(begins, F.regexp_replace(text, r"^\x{FEFF}", "")).otherwise(text)


def hidden_count(text: Column, category: str, begins: Column | None = None) -> Column:
    """Hidden characters of a category; begins: whether the text is where its file begins (by default it is)."""
    if category == "bidi_control":
        return F.regexp_count(text, F.lit(BIDI))
    clean = _cleaned(text, F.lit(True) if begins is None else begins)
    joiners = F.regexp_count(clean, F.lit(f"(?<={ASCII_TOKEN}){JOINERS}(?={ASCII_TOKEN})"))
    return F.regexp_count(clean, F.lit(INVISIBLE)) + joiners + F.length(clean) - F.length(F.regexp_replace(clean, VARIATION_RUN, ""))


def code_points(chars: Column) -> Column:
    """U+XXXX of each character of an array."""
    number = lambda x: F.regexp_replace(F.hex(F.encode(x, "UTF-32")), "^0+(?=.{4})", "")
    return F.transform(chars, lambda x: F.concat(F.lit("U+"), number(x)))


def hidden_places(lines: DataFrame) -> DataFrame:
    """lines with `content`, exploded to start (UTF-16), category and code_point of each hidden character; `line` tells whether a file begins there."""
    from .spans import match_spans, units

    pattern = f"(?<!{ASCII_TOKEN}){FLAGS}|{FLAGS}(?!{ASCII_TOKEN})|{BIDI}|{INVISIBLE}|{VARIATION_RUN}|(?<={ASCII_TOKEN}){JOINERS}(?={ASCII_TOKEN})"
    found = lines.where(F.col("content").rlike(pattern)).withColumn("m", F.explode(match_spans(F.col("content"), pattern, keep=lambda t: ~t.startswith("\U0001f3f4"))))
    found = found.where(~((F.col("line") == 1) & (F.col("m.start") == 0) & (F.col("m.text") == "\ufeff")))
    chars = found.select("*", F.posexplode(F.split("m.text", "")).alias("p", "x"))
    before = F.substring("m.text", F.lit(1), F.col("p"))
    return chars.select(
        *(c for c in lines.columns if c != "content"),
        (F.col("m.start") + units(before)).cast("int").alias("start"),
        F.when(F.col("x").rlike(BIDI), "bidi_control").otherwise("invisible_character").alias("category"),
        F.conv(F.hex(F.encode("x", "UTF-32")), 16, 10).cast("int").alias("code_point"),
    )


def has_hidden(text: Column, category: str, begins: Column | None = None) -> Column:
    """Whether there is any; a search that ends at the first."""
    if category == "bidi_control":
        return text.rlike(BIDI)
    clean = _cleaned(text, F.lit(True) if begins is None else begins)
    return text.rlike(f"{INVISIBLE}|{VARIATION_RUN}|{JOINERS}") & clean.rlike(f"{INVISIBLE}|{VARIATION_RUN}|{ASCII_TOKEN}{JOINERS}{ASCII_TOKEN}")


def has_secret(line: Column) -> Column:
    """A literal secret that is no placeholder, on a line without a private key (which is its own finding)."""
    return line.rlike(SECRET_LINE) & ~line.rlike(PLACEHOLDER) & ~line.rlike(PRIVATE_KEY_LINE)


def is_remote_default(line: Column) -> Column:
    return line.rlike(REMOTE_LINE) & ~line.rlike(IGNORED_LINE)


def copies_environment(line: Column) -> Column:
    """Reported where the line is no unsafe remote command."""
    return line.rlike(ENV_COPY_LINE) & ~line.rlike(IGNORED_LINE) & ~line.rlike(REMOTE_LINE)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole from counts; an empty whole is fully covered."""
    return F.when(whole == 0, F.lit(100.0)).otherwise(F.round(part * 100.0 / whole, digits))


def host_of(url: Column) -> Column:
    """Lower-case host of an http(s) URL, without port or user; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """Path of an http(s) URL, without query and fragment; at least '/'."""
    path = F.regexp_extract(url, r"^https?://[^/?#]+(/[^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)
