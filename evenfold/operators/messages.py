"""At-least-once delivery: exactly one row of each message (problem 2).

An identifier that is a UUID is read as a producer-sequence pair: the upper 64
bits are the producer, the lower 64 bits its number. What was seen is kept as
disjoint ranges [lo, hi] of numbers per producer; whatever doesn't parse is kept
as an exact key. Batches are taken up in order: a number that no range covers is
accepted and joins the ranges, a covered one is a repeat. Both states are
DataFrames and may be written and read again.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenfold.functions.ids import hyphened, uuid_hex

#: Numbers are cut into blocks of 2**BLOCK_BITS, so that no producer's ranges meet in one task.
BLOCK_BITS = 16
ID = ("_producer", "_number", "_key")


def _long(hex16: Column) -> Column:
    """Signed 64-bit value of 16 hex digits."""
    half = lambda at: F.conv(F.substring(hex16, at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def _hex(number: Column) -> Column:
    return F.lpad(F.lower(F.hex(number)), 16, "0")


def identify(df: DataFrame, id_col: str, producer: str | None = None, number: str | None = None) -> DataFrame:
    """Adds _producer, _number and _key. With producer and number columns, these are used (a row that
    lacks either falls back to its exact id). A null id is the key '' of its own: no row is lost."""
    if producer and number:
        ok = F.col(producer).isNotNull() & F.col(number).isNotNull()
        made = {"_producer": F.when(ok, F.xxhash64(F.col(producer))), "_number": F.when(ok, F.col(number).cast("long"))}
        return df.withColumns(made | {"_key": F.when(~ok, F.coalesce(F.trim(F.col(id_col)), F.lit("")))})
    h = uuid_hex(id_col)
    return (
        df.withColumn("_h", h)
        .withColumns({
            "_producer": _long(F.substring("_h", 1, 16)),
            "_number": _long(F.substring("_h", 17, 16)),
            "_key": F.when(F.col("_h").isNull(), F.coalesce(F.trim(F.col(id_col)), F.lit(""))),
        })
        .drop("_h")
    )


class SeenRanges:
    """Disjoint, sorted ranges of the numbers seen of one producer, no two of which touch."""

    __slots__ = ("hi", "lo")

    def __init__(self) -> None:
        self.lo: list[int] = []
        self.hi: list[int] = []

    def covers(self, n: int) -> bool:
        i = bisect_right(self.lo, n) - 1
        return i >= 0 and n <= self.hi[i]

    def add(self, lo: int, hi: int) -> None:
        """Takes a range in and merges it with those that it meets or touches."""
        a = bisect_right(self.lo, lo)
        if a and self.hi[a - 1] >= lo - 1:
            a -= 1
        b = bisect_right(self.lo, hi + 1)
        if a < b:
            lo, hi = min(lo, self.lo[a]), max(hi, self.hi[b - 1])
        self.lo[a:b], self.hi[a:b] = [lo], [hi]

    def accept(self, n: int) -> bool:
        """Whether the number is new; it is seen from now on."""
        if self.covers(n):
            return False
        self.add(n, n)
        return True


_TAKEN = pa.schema([("_p", pa.int64()), ("_n", pa.int64()), ("_k", pa.string()), ("_batch", pa.int64()), ("rejected", pa.int64())])


def _message() -> dict[str, Column]:
    """The message of an identified row, without nulls: malformed identifiers have a key that starts with =, all others the empty one."""
    return {"_p": F.coalesce("_producer", F.lit(0)), "_n": F.coalesce("_number", F.lit(0)), "_k": F.coalesce(F.concat(F.lit("="), F.col("_key")), F.lit(""))}


def _plain_id() -> Column:
    return F.when(F.col("_k") != "", F.substring("_k", 2, 1 << 30)).otherwise(hyphened(F.concat(_hex(F.col("_p")), _hex(F.col("_n")))))


class _Block:
    """One producer's block, or one malformed key, as its batches come in."""

    def __init__(self) -> None:
        self.ranges, self.keys, self.messages = SeenRanges(), set(), {}

    def seed(self, lo: int, hi: int, key: str) -> None:
        if key:
            self.keys.add(key)
        else:
            self.ranges.add(lo, hi)

    def row(self, number: int, key: str, batch: int, n: int) -> None:
        if key:
            new = key not in self.keys
            self.keys.add(key)
        else:
            new = self.ranges.accept(number)
        if new:
            self.messages[number] = [batch, n - 1]
        else:
            self.messages.setdefault(number, [None, 0])[1] += n


def _take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_p, _b, _k, _seed, _batch, _n, _hi, n) in order, by block; each message once. A block of one row, which is what most
    identifiers without a sequence come to, has nothing to cover it and is settled without a state."""
    at, block = None, _Block()

    def flush() -> tuple[list, ...]:
        got = [(at[0], number, at[2], *m) for number, m in block.messages.items()] if at else []
        return tuple(zip(*got, strict=True)) if got else ()

    for batch in batches:
        p, b, seed, when, n, hi, rows = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_p", "_b", "_seed", "_batch", "_n", "_hi", "n"))
        key = batch.column("_k").to_numpy(zero_copy_only=False)
        if not len(p):
            continue
        first = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (b[1:] != b[:-1]) | (key[1:] != key[:-1])])
        size = np.diff(np.r_[first, len(p)])
        alone = (size == 1) & ~seed[first]
        alone[0] = alone[-1] = False  # they may belong to blocks that began before or go on
        s = first[alone]
        out = [[p[s]], [n[s]], [key[s]], [when[s]], [rows[s] - 1]]
        for i, m in zip(first[~alone].tolist(), size[~alone].tolist(), strict=True):
            here = (int(p[i]), int(b[i]), key[i])
            if here != at:
                for col, got in zip(out, flush(), strict=False):
                    col.append(np.array(got, object))
                at, block = here, _Block()
            for j in range(i, i + m):
                if seed[j]:
                    block.seed(int(n[j]), int(hi[j]), key[j])
                else:
                    block.row(int(n[j]), key[j], int(when[j]), int(rows[j]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.asarray(x, object) for x in c]), f.type) for c, f in zip(out, _TAKEN, strict=True)], schema=_TAKEN)
    got = flush()
    if got:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(got, _TAKEN, strict=True)], schema=_TAKEN)


def deliveries(identified: DataFrame, batch: str | None = None, ranges: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """(_p, _n, _k, _batch, rejected): every message of an identified table with the batch that it is accepted from (null if the state covers it) and the
    number of rows rejected as repeats. Batches come in order of the column batch, a null one first; ranges (_producer, lo, hi) and keys
    (_key) are what was seen before. Rows of one message and batch are counted before they are moved, so a hot message
    costs one row per task and batch; a hot producer is spread over its blocks, of 2**BLOCK_BITS numbers each."""
    when = F.coalesce(F.col(batch).cast("long"), F.lit(-(1 << 62))) if batch else F.lit(0).cast("long")
    msg = list(_message())
    rows = identified.select(*(c.alias(k) for k, c in _message().items()), when.alias("_batch")).groupBy(*msg, "_batch").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumns({"_b": F.shiftright("_n", BLOCK_BITS), "_seed": F.lit(False), "_hi": F.col("_n")})
    if ranges is not None:
        old = in_blocks(ranges).select(F.col("_producer").alias("_p"), F.col("lo").alias("_n"), F.lit("").alias("_k"), F.lit(0).cast("long").alias("_batch"), F.lit(0).cast("long").alias("n"), F.col("b").alias("_b"), F.lit(True).alias("_seed"), F.col("hi").alias("_hi"))
        rows = rows.unionByName(old)
    if keys is not None:
        zero = F.lit(0).cast("long")
        old = keys.where("_key is not null").select(zero.alias("_p"), zero.alias("_n"), F.concat(F.lit("="), "_key").alias("_k"), zero.alias("_batch"), zero.alias("n"), zero.alias("_b"), F.lit(True).alias("_seed"), zero.alias("_hi")).distinct()
        rows = rows.unionByName(old)
    spread = rows.repartition("_p", "_b", "_k").sortWithinPartitions("_p", "_b", "_k", F.col("_seed").desc(), "_batch", "_n")
    return spread.mapInArrow(_take, "_p long, _n long, _k string, _batch long, rejected long")


def repeated(df: DataFrame, id_col: str, batch: str | None = None) -> DataFrame:
    """(message_id, n_rows) of the messages on more than one row: those with rows that the seen ranges (for malformed identifiers: the seen
    keys) reject. Null ids are no message."""
    known = df.select(F.col(id_col).alias("_id"), *([F.col(batch).alias("_at")] if batch else [])).where("_id is not null")
    taken = deliveries(identify(known, "_id"), "_at" if batch else None).where("rejected > 0")
    return taken.select(_plain_id().alias("message_id"), (F.col("rejected") + 1).alias("n_rows"))


def in_blocks(ranges: DataFrame) -> DataFrame:
    """(_producer, b, lo, hi): ranges (_producer, lo, hi) cut at the borders of blocks. A range holds numbers that were seen, so there is one row
    per 2**BLOCK_BITS messages and range: fewer than there were messages."""
    spans = ranges.where(F.col("_producer").isNotNull() & F.col("lo").isNotNull()).select("_producer", "lo", "hi")
    parts = spans.select("_producer", F.explode(F.sequence(F.shiftright("lo", BLOCK_BITS), F.shiftright("hi", BLOCK_BITS))).alias("b"), "lo", "hi")
    top = F.shiftleft("b", BLOCK_BITS).bitwiseOR(F.lit((1 << BLOCK_BITS) - 1))
    return parts.select("_producer", "b", F.greatest("lo", F.shiftleft("b", BLOCK_BITS)).alias("lo"), F.least("hi", top).alias("hi"))


def merge_ranges(numbers: DataFrame) -> DataFrame:
    """Disjoint ranges (_producer, lo, hi) of rows with _producer and either _number or lo and hi.

    Ranges are merged within blocks first and then across block borders, on two rows
    per block at most: a producer with a third of all numbers is spread over its blocks."""
    if "lo" not in numbers.columns:
        numbers = numbers.select("_producer", F.col("_number").alias("lo"), F.col("_number").alias("hi"))
    inner = _islands(in_blocks(numbers).distinct(), ["_producer", "b"])
    top = F.lit((1 << BLOCK_BITS) - 1)
    edge = (F.col("lo").bitwiseAND(top) == 0) | (F.col("hi").bitwiseAND(top) == top)
    done = inner.where(~edge).select("_producer", "lo", "hi")
    return done.unionByName(_islands(inner.where(edge).drop("b"), ["_producer"]).select("_producer", "lo", "hi"))


def _islands(spans: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("lo", "hi")
    seen = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(seen.isNull() | (F.col("lo") > seen + 1), 1).otherwise(0)
    return spans.withColumn("_s", starts).withColumn("_g", F.sum("_s").over(w)).groupBy(*by, "_g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_g")


def accept(rows: DataFrame, id_col: str, order_by: list[str], ranges: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """The rows to accept: one per message that the state doesn't cover yet. Batches, told by the first column of order_by (a number), are taken up in order;
    of a message's rows in its batch the first by order_by is accepted, then by all other columns, so that ties are settled.
    Null ids can't be told apart and are all kept. A row is moved once, after the rows of its message in its task were reduced to the first."""
    rest = [c for c in rows.columns if c not in order_by]
    plain = not any(_unordered(rows.schema[c].dataType) for c in rows.columns)
    named = [F.col(c).alias(f"f{i}") for i, c in enumerate([*order_by, *rest])]
    row = F.struct(*named)
    back = [F.col(f"_row.f{[*order_by, *rest].index(c)}").alias(c) for c in rows.columns]
    slim = identify(rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(order_by[0]).cast("long").alias("_at"), row.alias("_row")), "_id")
    when = F.coalesce("_at", F.lit(-(1 << 62))).alias("_batch")
    best = F.min("_row") if plain else F.min_by("_row", F.struct(*(F.col(f"_row.f{i}") for i in range(len(order_by))), F.to_json("_row")))
    key = [*_message(), "_batch"]
    firsts = slim.select(*(c.alias(k) for k, c in _message().items()), when, "_row").groupBy(*key).agg(best.alias("_row"))
    taken = deliveries(slim.select(*ID, "_at"), "_at", ranges, keys).where("_batch is not null").select(*key)
    kept = firsts.join(taken, key, "left_semi").select(*back)
    return kept.unionByName(rows.where(F.col(id_col).isNull()))


def _unordered(kind: T.DataType) -> bool:
    """Whether values of a type have no order (maps, variants and what holds them)."""
    if isinstance(kind, T.StructType):
        return any(_unordered(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _unordered(kind.elementType)
    return isinstance(kind, T.MapType | T.VariantType)
