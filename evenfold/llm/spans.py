"""Long exact spans shared between records (problem 10).

A character is shared if it lies in a window of LENGTH characters that stands
so in another row. Probing an index of fixed blocks with every rolling window
would move one row per character, so the windows are gathered under anchors
first: a window's anchor is the block of BLOCK characters in it with the least hash,
which is the same block wherever the window stands. Consecutive windows with one
anchor make one run, about one per 130 characters.

1. Runs are indexed by their anchor block and by their whole stretch. A block in only one row ends the matter for all its
   windows; a whole stretch that stands in two rows settles all of them as shared.
2. The runs in between (the anchor is shared, the stretch isn't) are probed with every rolling window in them, against each
   other and against two rows of each settled stretch.
3. Windows that hit are merged to maximal spans, row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenfold.session import cut

LENGTH = 400
BLOCK = 128
#: Texts are hashed in pieces of this many characters, which overlap by a window.
PIECE = 1 << 18
_POS = np.uint64((1 << 20) - 1)
_ODD = 0x9E3779B97F4A7C15


@lru_cache(maxsize=2)
def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    n = PIECE + 1
    with np.errstate(over="ignore"):
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
    return both[0], both[1]


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finisher of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Piece:
    """Rolling hashes of one piece of a text."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.points = _mix(points.astype(np.uint64) * np.uint64(2) + np.uint64(1))
        self.sums: dict[int, np.ndarray] = {}

    def _sum(self, base: int) -> np.ndarray:
        if base not in self.sums:
            with np.errstate(over="ignore"):
                s = np.zeros(self.n + 1, np.uint64)
                np.cumsum(self.points * _powers(base)[0][: self.n], out=s[1:])
            self.sums[base] = s
        return self.sums[base]

    def hashes(self, start: np.ndarray, end: np.ndarray, base: int = _ODD) -> np.ndarray:
        """Hashes of the stretches [start, end), equal for equal stretches wherever they stand."""
        s = self._sum(base)
        with np.errstate(over="ignore"):
            return _mix((s[end] - s[start]) * _powers(base)[1][start])

    def rolling(self, size: int, base: int = _ODD) -> np.ndarray:
        """Hashes of all stretches of a size."""
        s, m = self._sum(base), self.n - size + 1
        with np.errstate(over="ignore"):
            return _mix((s[size:] - s[:m]) * _powers(base)[1][:m])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of every w consecutive values: prefix minima of blocks of w against suffix minima."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def pieces(text: str, length: int) -> Iterator[tuple[int, Piece]]:
    """(offset, piece): every window of the length lies in exactly one piece."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(points) - length + 1, PIECE - length + 1):
        yield at, Piece(points[at : at + PIECE])


def anchored(piece: Piece, length: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (anchor's hash, anchor's place, first window, last window). Of equal blocks in a window
    the last is the anchor."""
    h = piece.rolling(block)
    n = len(h)
    keyed = (h & ~_POS) | (_POS - np.arange(n, dtype=np.uint64))
    anchor = (_POS - (_sliding_min(keyed, length - block + 1) & _POS)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    last = np.r_[first[1:], len(anchor)] - 1
    return h[anchor[first]], anchor[first], first, last


#: A run's first window, the windows after it and the place of its anchor in it are packed into one number, as runs are most of what is moved.
_RUN = pa.schema([("anchor", pa.int64()), ("whole", pa.int64()), ("doc_id", pa.int64()), ("packed", pa.int64())])
_BITS = 12


def _lo() -> Column:
    return F.shiftright("packed", 2 * _BITS)


def _hi() -> Column:
    return _lo() + F.shiftright("packed", _BITS).bitwiseAND(F.lit((1 << _BITS) - 1))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _runs(length: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list[np.ndarray]] = [[] for _ in _RUN]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(text) < length:
                    continue
                for at, piece in pieces(text, length):
                    h, place, first, last = anchored(piece, length, block)
                    whole = piece.hashes(first, last + length)
                    with np.errstate(over="ignore"):  # the same stretch around another anchor place is another run
                        whole = _mix(whole + (place - first).astype(np.uint64) * np.uint64(_ODD) + (last - first).astype(np.uint64))
                    packed = (first + at) << 2 * _BITS | (last - first) << _BITS | (place - first)
                    for col, got in zip(cols, (_signed(h), _signed(whole), np.full(len(h), doc, np.int64), packed), strict=True):
                        col.append(got)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.empty(0, np.int64)) for c in cols], schema=_RUN)

    return run


_PROBE = pa.schema([("anchor", pa.int64()), ("window", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64())])


def _probes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, runs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                cols: list[list[np.ndarray]] = [[] for _ in _PROBE]
                runs = sorted((r["lo"], r["hi"], r["anchor"]) for r in runs)
                for at, piece in pieces(text, length):
                    h = piece.rolling(length)
                    for lo, hi, anchor in runs:
                        if at <= lo < at + len(h):
                            w = np.arange(lo, hi + 1, dtype=np.int64)
                            for col, got in zip(cols, (np.full(len(w), anchor, np.int64), _signed(h[w - at]), np.full(len(w), doc, np.int64), w), strict=True):
                                col.append(got)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(cols, _PROBE, strict=True)], schema=_PROBE)

    return run


_SPAN = pa.schema([("doc_id", pa.int64()), ("start_pos", pa.int64()), ("end_pos", pa.int64())])


def _merged(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for doc, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = end = None
                for lo, hi in sorted((r["lo"], r["hi"]) for r in found):
                    if start is None or lo > end:
                        if start is not None:
                            out.append((doc, start, end))
                        start, end = lo, hi + length
                    else:
                        end = max(end, hi + length)
                if start is not None:
                    out.append((doc, start, end))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_SPAN)], schema=_SPAN)

    return run


def shared_spans(documents: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """(doc_id, start_pos, end_pos): the longest unbroken stretches of shared characters, in code points. Rows without doc_id or text
    share nothing, nor do texts shorter than length; doc_id is taken as unique, so a stretch that repeats within one
    row isn't shared. Groups are reduced by least and greatest doc_id before the shuffle: a stretch in a third of all rows costs one row per task."""
    if not 0 < block <= length < block + (1 << _BITS):
        raise ValueError("block must be at most length, and length less than block + 4096")
    rows = documents.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    runs = cut(rows.mapInArrow(_runs(length, block), "anchor long, whole long, doc_id long, packed long"))
    common = runs.groupBy("anchor").agg(F.min("doc_id").alias("a0"), F.max("doc_id").alias("a1")).where("a0 <> a1").select("anchor")
    near = cut(runs.join(common, "anchor"))  # the few runs whose anchor stands in two rows
    stretches = near.groupBy("anchor", "whole").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"))
    several = stretches.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    kept = near.join(stretches.join(several, "anchor").where("d0 <> d1 or n > 1"), ["anchor", "whole"])
    sure = kept.where("d0 <> d1").select("doc_id", _lo().alias("lo"), _hi().alias("hi"))
    # stretches of one row, and two rows of the others wherever there is something to compare with them
    doubtful = kept.where("n > 1 and (doc_id = d0 or doc_id = d1)").groupBy("doc_id").agg(F.collect_list(F.struct(_lo().alias("lo"), _hi().alias("hi"), "anchor")).alias("runs"))  # of one text
    probes = rows.join(doubtful, "doc_id").select("doc_id", "text", "runs").mapInArrow(_probes(length), "anchor long, window long, doc_id long, at long")
    key = ["anchor", "window"]  # probed twice rather than written: the windows outweigh the texts
    hits = probes.groupBy(*key).agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")).where("d0 <> d1").select(*key)
    hit = probes.join(hits, key, "left_semi").select("doc_id", F.col("at").alias("lo"), F.col("at").alias("hi"))
    found = sure.unionByName(hit).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))  # of one text
    return found.mapInArrow(_merged(length), "doc_id long, start_pos long, end_pos long")


def shared_shares(documents: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_chars, shared_chars, share) of every row with a doc_id; a null text has no characters and the share 0."""
    spans = shared_spans(documents, length, block).groupBy("doc_id").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared_chars"))
    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"))
    out = rows.join(spans, "doc_id", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)))
    return out.withColumn("share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0))
