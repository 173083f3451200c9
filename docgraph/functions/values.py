"""Scalar functions over markup values, names and text: Column in, Column out."""

from __future__ import annotations

import re
from decimal import ROUND_FLOOR, ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

INTEGER, REAL = r"^[+-]?\d+$", r"^[+-]?(\d+\.\d*|\.\d+|\d+[eE])([eE]?[+-]?\d+)?$"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: Schemes a link may have.
SCHEMES = ("http", "https", "mailto", "tel")


def coerce(raw: Column) -> Column:
    """struct(text, num, bool, kind): quoted is a string, true/false a boolean, integer or float syntax a number."""
    t = F.trim(raw)
    quoted = (F.length(t) >= 2) & t.startswith('"') & t.endswith('"')
    is_bool, is_num = t.isin("true", "false"), t.rlike(NUMBER)
    kind = F.when(quoted, "string").when(is_bool, "boolean").when(is_num, "number").otherwise("string")
    return F.struct(
        F.when(quoted, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t).alias("text"),
        F.when(~quoted & is_num, t.try_cast("double")).alias("num"),
        F.when(is_bool, t == "true").alias("bool"),
        kind.alias("kind"),
    )


def cell_number(text: Column) -> Column:
    """The number in a table cell, or null."""
    t = F.trim(text)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def attribute_tokens(raw: Column) -> Column:
    inner = F.regexp_replace(F.trim(raw), r"^\{|\}$", "")
    return F.regexp_extract_all(inner, F.lit(r'((?:[^\s"]|"[^"]*")+)'), F.lit(1))


def parse_attrs(raw: Column) -> Column:
    """struct(id, classes, attrs) of ``{#id .class key=value flag}``; a bare word is true."""
    tokens = attribute_tokens(raw)
    ids = F.filter(tokens, lambda t: t.startswith("#"))
    rest = F.filter(tokens, lambda t: ~t.startswith("#") & ~t.startswith("."))
    pair = lambda t: F.struct(
        F.substring_index(t, "=", 1).alias("key"),
        F.when(t.contains("="), F.regexp_replace(F.substring(t, F.instr(t, "=") + 1, F.length(t)), '^"|"$', "")).otherwise(F.lit("true")).alias("value"),
    )
    keys = F.transform(rest, lambda t: F.substring_index(t, "=", 1))
    last = F.filter(F.transform(rest, pair), lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(keys), F.lit(1))), p["key"]))
    return F.struct(
        F.substring(F.get(ids, F.size(ids) - 1), 2, 1 << 20).alias("id"),
        F.transform(F.filter(tokens, lambda t: t.startswith(".")), lambda t: F.substring(t, 2, 1 << 20)).alias("classes"),
        F.map_from_entries(last).alias("attrs"),
    )


def parse_data(body: Column) -> Column:
    """(key, value) entries of ``key = value`` lines in order; lines without ``=`` are skipped."""
    lines = F.filter(F.split(body, "\n"), lambda x: x.contains("="))
    return F.transform(
        lines,
        lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), F.trim(F.substring(x, F.instr(x, "=") + 1, F.length(x))).alias("value")),
    )


def slug(heading: Column) -> Column:
    """Heading id: lower case without code spans; letters, digits, blanks and hyphens; blanks to hyphens."""
    bare = F.lower(F.trim(F.regexp_replace(heading, "`[^`]*`", "")))
    return F.regexp_replace(F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}\s-]", "")), r"\s+", "-")


def github_slug(heading: Column) -> Column:
    """The variant that keeps code and underscores, one hyphen a blank."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(heading)), r"[^\p{L}\p{N}\s_-]", ""), r"\s", "-")


def safe_url(url: Column, media: bool = False) -> Column:
    """Whether a url has no scheme or an allowed one, control characters set aside; data:image/ for media."""
    bare = F.regexp_replace(url, r"[\x00-\x20\x7F]", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    image = F.lower(bare).startswith("data:image/") if media else F.lit(False)
    return (scheme == "") | scheme.isin(*SCHEMES) | image


def media_kind(url: Column) -> Column:
    path = F.lower(F.regexp_replace(url, r"[?#].*$", ""))
    return F.when(path.rlike(r"\.(mp4|webm|ogv|mov)$"), "video").when(path.rlike(r"\.(mp3|wav|ogg|m4a|flac)$"), "audio").otherwise("image")


def task_state(item: Column) -> Column:
    """true, false or null (no task) from ``[x] `` and ``[ ] ``."""
    mark = F.regexp_extract(item, r"^\[([ xX])\]\s", 1)
    return F.when(mark == "", F.lit(None)).otherwise(F.lower(mark) == "x")


def csv_cell(text: Column) -> Column:
    return F.trim(F.translate(text, ",\r\n[]", "   ()"))


def attribute_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, '"', "'"), r"\s+", " "))


def content_hash(text: Column, newline: Column | str = "\n", digits: int = 64) -> Column:
    """Hex digits of the SHA-256 of the text with the recorded line ends."""
    nl = F.lit(newline) if isinstance(newline, str) else newline
    return F.substring(F.sha2(F.encode(F.replace(text, F.lit("\n"), nl), "UTF-8"), 256), 1, digits)


def revision_id(ts: Column, digest: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), F.substring(digest, 1, 8))


def revision_time(revision: Column) -> Column:
    return F.to_timestamp(F.substring(revision, 1, 16), "yyyyMMdd'T'HHmmss'Z'")


def lookup_names(name: Column) -> Column:
    """The name, and what follows its first dot, or else its first ``::``."""
    dot = F.when(F.instr(name, ".") > 0, F.substring(name, F.instr(name, ".") + 1, F.length(name)))
    colons = F.when(F.instr(name, "::") > 0, F.substring(name, F.instr(name, "::") + 2, F.length(name)))
    return F.array_distinct(F.array_compact(F.array(name, F.coalesce(dot, colons))))


def last_part(name: Column) -> Column:
    """What follows the last dot or ``::``."""
    return F.regexp_extract(name, r"([^.:]*)$", 1)


def qualified_name(full: Column) -> Column:
    """Class.method from a dotted full name; constructors are ``new`` and ``static{}``."""
    cut = F.regexp_extract(full, r"([^.:]+)\.([^.:]+)(?::.*)?$", 1)
    method = F.regexp_extract(full, r"([^.:]+)(?::.*)?$", 1)
    named = F.when(method == "<init>", "new").when(method == "<clinit>", "static{}").otherwise(method)
    return F.when(cut == "", named).otherwise(F.concat_ws(".", cut, named))


#: Buckets of diagnostics and what their messages have, in the order they are tried.
CATEGORIES = (
    ("unterminated", "unterminated fence (nesting)"), ("unknown metadata reference", "unknown {{meta}} key"), ("unresolved reference|unresolved footnote", "unresolved ref/footnote"),
    ("duplicate id", "duplicate id"), ("compute|summary|aggregate|cannot lex|formula", "table formula (compute/summary)"), ("span", "table span"),
    ("-chart|chart:", "chart binding"), ("cannot resolve document", "cross-doc ref"),
)


def error_category(message: Column) -> Column:
    """First bucket whose pattern the message has, or ``other:`` and its beginning."""
    out = F.concat(F.lit("other: "), F.substring(message, 1, 40))
    for pattern, name in reversed(CATEGORIES):
        out = F.when(message.rlike(pattern), name).otherwise(out)
    return out


def trimmed_lines(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.rtrim(x)), "\n")


PRINTF = re.compile(r"%%|%[-+ 0]*\d*(?:\.(\d+))?([fFeEgGd])")


def _fixed(v: float, digits: int) -> str:
    """v with so many digits: its exact binary value, ties away from zero."""
    scaled = v * 10.0**digits * 2
    if scaled == int(scaled) and int(scaled) % 2:  # only such values can be ties, which "%f" rounds to even
        return str(Decimal(v).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return f"{v:.{digits}f}"


def _piece(m: re.Match):
    """What a conversion makes of a number."""
    if m[2] is None:
        return lambda v: "%"
    digits = int(m[1]) if m[1] is not None else None
    if m[2] == "d":
        return lambda v: str(int((Decimal(v) + Decimal("0.5")).to_integral_value(ROUND_FLOOR)))
    if m[2] in "fF":
        return lambda v: _fixed(v, 6 if digits is None else digits)
    return (lambda v: f"{v:.{6 if digits is None else digits}e}") if m[2] in "eE" else (lambda v: f"{v:.{6 if digits is None else digits}g}")


def printf(fmt: str, value: Column) -> Column:
    """Formatted number: rounds the exact binary value, ties away from zero; %d rounds half up. (Spark's format_string rounds the shortest decimal.)

    The format is taken apart once; each distinct number of a batch is formatted once.
    """
    found = list(PRINTF.finditer(fmt))
    ends = [0, *(m.end() for m in found)]
    between = [fmt[a : m.start()] for a, m in zip(ends, found, strict=False)] + [fmt[ends[-1] :]]
    pieces = [_piece(m) for m in found]

    @F.pandas_udf("string")
    def run(v: pd.Series) -> pd.Series:
        def text(x: float) -> str | None:
            if x != x or x in (float("inf"), float("-inf")):
                return None
            return between[0] + "".join(p(x) + b for p, b in zip(pieces, between[1:], strict=True))

        codes, own = pd.factorize(v)
        made = [text(float(x)) for x in own]
        return pd.Series([made[c] if c >= 0 else None for c in codes], dtype=object)

    return run(value.cast("double"))


def number_text(value: Column) -> Column:
    """Default text of a number: 12 significant digits, then the shortest form."""

    @F.pandas_udf("string")
    def run(v: pd.Series) -> pd.Series:
        def text(x: float) -> str:
            y = float(f"{x:.12g}")
            return str(int(y)) if y == int(y) and abs(y) < 1e21 else repr(y)

        codes, own = pd.factorize(v)
        made = [text(float(x)) for x in own]
        return pd.Series([made[c] if c >= 0 else None for c in codes], dtype=object)

    return run(value.cast("double"))
