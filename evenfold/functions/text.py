"""Normalization of lines as column expressions. Only Unicode composition needs Python, in Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from evenfold.schema import Profile

SPACE = r"\p{IsWhite_Space}"
#: Characters without width that votes are compared without.
INVISIBLE = r"­​‌‍⁠﻿"


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition; null stays null."""
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


# A filter on a composed text must not be pushed below it, as that would compose every text once for the filter and once for the result.
nfc = nfc.asNondeterministic()


def trim(c: Column) -> Column:
    """Trims every Unicode white space."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def decimal_comma(c: Column) -> Column:
    """A comma between two ASCII digits becomes a point; each comma looks at its neighbours in the original."""
    return F.regexp_replace(c, "(?<=[0-9]),(?=[0-9])", ".")


def canonical(c: Column) -> Column:
    """Composition, trim, decimal point."""
    return decimal_comma(trim(nfc(c)))


def collapse(c: Column) -> Column:
    """Runs of ASCII white space (without the vertical tab) become one space; then trim."""
    return trim(F.regexp_replace(c, "[ \\t\\n\\f\\r]+", " "))


def by_profile(c: Column, p: Profile) -> Column:
    out = canonical(c)
    out = collapse(out) if p.normalize_whitespace else out
    return F.lower(out) if p.normalize_case else out


def display(c: Column) -> Column:
    """What a vote shows: composed, without invisible and control characters, white space collapsed. Controls other than tab and line
    ends are dropped before white space is looked at, so their neighbours grow together."""
    bare = F.regexp_replace(nfc(c), f"[{INVISIBLE}]|[\\p{{Cc}}&&[^\\n\\t\\r]]", "")
    return F.regexp_replace(trim(bare), f"{SPACE}+", " ")


def vote_variant(c: Column) -> Column:
    return decimal_comma(display(c))


def vote_key(c: Column) -> Column:
    return F.lower(vote_variant(c))


def plain(c: Column) -> Column:
    """Lower case, letters and digits and single spaces; everything else is deleted (not replaced)."""
    kept = F.regexp_replace(F.lower(c), f"[^\\p{{IsAlphabetic}}\\p{{N}}{SPACE}]", "")
    return F.trim(F.regexp_replace(kept, f"{SPACE}+", " "))


def numeric_tokens(c: Column) -> Column:
    """Runs of digits and points that hold a digit."""
    return F.regexp_extract_all(c, F.lit("([0-9.]*[0-9][0-9.]*)"), F.lit(1))


def negated(c: Column) -> Column:
    """Whether a word of the text is 'non'."""
    return F.array_contains(F.split(c, f"{SPACE}+"), "non")


def has_cyrillic(c: Column) -> Column:
    return c.rlike("[\\u0400-\\u04FF]")


def veto(a: Column, b: Column) -> Column:
    """Why two keys must not be one: negation, numeric, or null. Negation is looked at first; numbers only if both have some."""
    x, y = numeric_tokens(a), numeric_tokens(b)
    return F.when(negated(a) != negated(b), "negation").when((F.size(x) > 0) & (F.size(y) > 0) & (x != y), "numeric")


def differs_in_numbers(a: Column, b: Column) -> Column:
    """Whether two texts are equal but for their digits."""
    x, y = F.lower(a), F.lower(b)
    bare = lambda c: F.regexp_replace(c, "[0-9]", "")
    return (bare(x) == bare(y)) & (F.split(x, "[^0-9]") != F.split(y, "[^0-9]"))
