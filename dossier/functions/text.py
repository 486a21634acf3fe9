"""Text expressions that behave alike on every Unicode blank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every code point that counts as white space in Unicode text. The class is
# spelled with \x{...} so that Java and RE2 read it the same way.
BLANKS = (
    r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
# The same class for Java only: letters leave it after three range checks.
WS = (
    r"[\x09-\x0D\x1C-\x20[\x{85}-\x{3000}&&[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]]"
)
CJK = r"[\x{4E00}-\x{9FFF}]"


def let(value: Column, use) -> Column:
    """Evaluate `value` once and hand it to `use` (a lambda body would evaluate it per element)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def explode_once(df, keys, array: Column, pos: str, item: str):
    """posexplode that evaluates a costly array once.

    A plain posexplode makes the optimizer add a size filter below it, which
    evaluates the array expression a second time.
    """
    return df.select(*keys, F.posexplode_outer(array).alias(pos, item)).filter(F.col(pos).isNotNull())


def squash(c) -> Column:
    """Collapse runs of blanks to one space and trim."""
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def drop_blanks(c) -> Column:
    return F.regexp_replace(c, WS + "+", "")


def strip_heading(c) -> Column:
    """Squash, then drop blanks and colons at both ends."""
    return F.btrim(squash(c), F.lit(" ：:"))


def non_blank(c) -> Column:
    """The squashed value, or null when nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def first_present(*cols, default=None) -> Column:
    """First non-blank value in order."""
    tail = [] if default is None else [default]
    return F.coalesce(*[non_blank(c) for c in cols], *tail)


def strings(values) -> Column:
    """A literal string array (empty arrays keep their type)."""
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def contains_any(c: Column, terms) -> Column:
    """True when at least one of the literal terms occurs in the text."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(t)) for t in terms], F.lit(False))


def hits(c: Column, terms) -> Column:
    """The terms found in the text, in list order. `terms` is a Python list or an array column."""
    arr = terms if isinstance(terms, Column) else strings(terms)
    return F.filter(arr, lambda t: (t != "") & F.contains(c, t))


def any_of(c: Column, arr: Column) -> Column:
    """True when at least one element of the array column occurs in the text."""
    return F.coalesce(F.exists(arr, lambda t: (t != "") & F.contains(c, t)), F.lit(False))


def first_rule(c: Column, rules) -> Column:
    """Value of the first (value, terms) rule with a term in the text, else null."""
    out = None
    for value, terms in rules:
        hit = contains_any(c, terms)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out


def ordered_distinct(*arrays) -> Column:
    """Concatenate arrays, drop nulls and empty strings, keep the first of each value."""
    parts = [F.coalesce(a, F.array().cast("array<string>")) for a in arrays]
    return F.array_distinct(F.filter(F.concat(*parts), lambda t: t.isNotNull() & (t != "")))


def language_of(c) -> Column:
    """zh when any CJK ideograph occurs, en when any latin letter, else neutral."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(CJK), "zh").when(c.rlike("[A-Za-z]"), "en").otherwise("neutral")


def cn_number(c) -> Column:
    """Digits or Chinese numerals 0-99 to int; null when the text is neither."""
    plain = F.translate(c, "零一二两三四五六七八九", "01223456789")
    tens = F.substring_index(plain, "十", 1)
    ones = F.substring_index(plain, "十", -1)
    return (
        F.when(c.rlike("^[0-9]{1,9}$"), c.try_cast("int"))
        .when(
            plain.rlike("^[0-9]?十[0-9]?$"),
            F.coalesce(tens.try_cast("int"), F.lit(1)) * 10 + F.coalesce(ones.try_cast("int"), F.lit(0)),
        )
        .when(plain.rlike("^[0-9]$"), plain.try_cast("int"))
    )


def span_text(text, start, end) -> Column:
    """Substring for a 0-based half-open span."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def find(text, needle, start=0) -> Column:
    """0-based position of the first occurrence at or after `start`, -1 when absent."""
    at = start if isinstance(start, Column) else F.lit(start)
    return F.call_function("locate", needle, text, at + 1) - 1


def numbered(prefix: str, n, width: int = 4) -> Column:
    return F.format_string(f"{prefix}%0{width}d", n.cast("int"))
