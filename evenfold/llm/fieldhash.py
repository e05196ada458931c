"""Lines that differ only in dress: case, white space, punctuation, order of fields (problem 7).

Each field of a line (between ``;`` or ``|``) is brought to its words and numbers
and hashed with its name and value together; the hashes are added up, so their order plays no
part. Lines are grouped by that fingerprint and compared field by field with
the group's first line, as multisets, without sorting. Everything is JVM-side.
Where the boundary between a field's name and its value matters, ``named`` hashes
the pair with it; lines whose marks are all dress are hashed without.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenfold.session import cut

#: A word is a run of letters and digits; a mark directly between two digits belongs to the number.
WORD = r"[\p{L}\p{N}]+(?:(?<=\p{Nd})[^\p{L}\p{N}\p{IsWhite_Space}](?=\p{Nd})[\p{L}\p{N}]+)*"
_MASK = (1 << 62) - 1


#: The same with the sign of a number that stands free.
SIGNED = rf"(?:(?<![\p{{L}}\p{{N}}])[-−+](?=\p{{Nd}}))?{WORD}"
#: What parts a field's name from its value: a colon or equals sign that doesn't stand between two digits.
_NAMED = r"^(.*?)(?:(?<!\p{Nd})[:=]|[:=](?!\p{Nd}))(.*)$"
_BOUNDARY = "\u001f"


def _words(text: Column, word: str) -> Column:
    return F.array_join(F.regexp_extract_all(text, F.lit(word), F.lit(0)), " ")


def fields_of(text: Column, named: bool = False) -> Column:
    """The normalized fields of a line; a field without words is none. A line without separators is one field. named keeps a field's name and its value
    apart, and the signs of numbers: ``name: a b`` is not ``name a: b`` then, nor ``t: -5`` ``t: 5``. Otherwise marks other than those in numbers
    don't count at all."""
    plain = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    pair = lambda f: F.when(f.rlike(_NAMED), F.concat(_words(F.regexp_extract(f, _NAMED, 1), WORD), F.lit(_BOUNDARY), _words(F.regexp_extract(f, _NAMED, 2), SIGNED))).otherwise(_words(f, SIGNED))
    words = F.transform(F.split(plain, "[;|]"), pair if named else lambda f: _words(f, WORD))
    return F.filter(words, lambda f: (f != "") & (f != _BOUNDARY))


def multiset_hash(fields: Column, seed: int) -> Column:
    """Sum of the fields' hashes modulo 2**62: the same for any order, and repeated fields count."""
    return F.aggregate(fields, F.lit(0).cast("long"), lambda acc, f: (acc + F.xxhash64(f, F.lit(seed)).bitwiseAND(F.lit(_MASK))).bitwiseAND(F.lit(_MASK)))


def same_fields(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same elements equally often."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return (a == b) | ((F.size(a) == F.size(b)) & F.forall(a, lambda x: times(a, x) == times(b, x)))


def _fields(lines: DataFrame, reading: list[str], id_col: str, text_col: str, named: bool) -> DataFrame:
    """(line_id, r, f): each line with its reading and its fields. Lines without words and rows without id are left out; a null in the reading
    is a value of its own."""
    r = F.struct(*(F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(reading)))
    rows = lines.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("line_id"), r.alias("r"), F.col(text_col).alias("t"))
    return rows.select("line_id", "r", fields_of(F.col("t"), named).alias("f")).where(F.size("f") > 0)


def fingerprints(lines: DataFrame, reading: list[str], id_col: str = "line_id", text_col: str = "text", named: bool = False) -> DataFrame:
    """(line_id, a, b): each line with 128 bits of its reading and fields. Written once, as bringing lines to their words is what costs here."""
    rows = _fields(lines, reading, id_col, text_col, named)
    key = F.struct(*(x for i in range(len(reading)) for x in (F.col(f"r.k{i}"), F.col(f"r.k{i}").isNull())))
    return cut(rows.select("line_id", F.xxhash64(key, multiset_hash(F.col("f"), 11)).alias("a"), F.xxhash64(multiset_hash(F.col("f"), 23), key).alias("b")))


def copies(lines: DataFrame, reading: list[str], id_col: str = "line_id", text_col: str = "text", named: bool = False) -> DataFrame:
    """(first_line_id, line_id) of every line but the first of its class, each once: the lines of one reading with the same fields in any order. A row that
    stands twice with one id is one line. Classes are reduced to their first and last id before the shuffle, so one with a third of all
    lines costs no more than others. Only lines with a partner are brought to their fields again, to be compared with their first line."""
    keyed = fingerprints(lines, reading, id_col, text_col, named)
    return _verified(keyed, lines, reading, id_col, text_col, named)


def _verified(keyed: DataFrame, lines: DataFrame, reading: list[str], id_col: str, text_col: str, named: bool) -> DataFrame:
    more = keyed.groupBy("a", "b").agg(F.min("line_id").alias("first_line_id"), F.max("line_id").alias("z")).where("first_line_id <> z").drop("z")
    members = cut(keyed.join(more, ["a", "b"]).select("line_id", "first_line_id").distinct())
    named_as = [f"k{i}" for i in range(len(reading))]  # the line's own columns may be called anything
    raw = lines.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("line_id"), F.col(text_col).alias("t"), *(F.col(c).cast("string").alias(k) for c, k in zip(reading, named_as, strict=True)))
    own = raw.join(members, "line_id")
    full = cut(own.select("line_id", "first_line_id", F.struct(*named_as).alias("r"), fields_of(F.col("t"), named).alias("f")))
    firsts = full.where("line_id = first_line_id").select("first_line_id", F.col("r").alias("r1"), F.col("f").alias("f1"))
    pairs = full.where("line_id <> first_line_id").join(firsts, "first_line_id").where(F.col("r").eqNullSafe(F.col("r1")) & same_fields(F.col("f"), F.col("f1")))
    return pairs.select("first_line_id", "line_id").distinct()


def counts(lines: DataFrame, reading: list[str], id_col: str = "line_id", text_col: str = "text", named: bool = False) -> DataFrame:
    """(first_line_id, n_copies): each distinct line of a reading once, with the number of its copies, itself included. Counted over verified copies."""
    keyed = fingerprints(lines, reading, id_col, text_col, named)
    first = keyed.select("line_id").distinct().join(_verified(keyed, lines, reading, id_col, text_col, named), "line_id", "left").select(F.coalesce("first_line_id", "line_id").alias("first_line_id"))
    return first.groupBy("first_line_id").agg(F.count(F.lit(1)).alias("n_copies"))
