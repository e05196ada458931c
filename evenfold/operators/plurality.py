"""The incremental reducer: counted votes, taken up in order.

A position's clusters depend only on its own texts in their order, so the fold
streams over partitions sorted by position and order; it holds one position at
a time, as counts of its different texts. Positions with many clusters look for
like ones through an index.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from evenfold.functions import text
from evenfold.functions.similarity import jaro_winkler

THRESHOLD = 0.90
#: The same texts are compared on many positions.
_alike = lru_cache(maxsize=100_000)(jaro_winkler)


def best_of(members: list[str]) -> str:
    """The longest by bytes, then the smallest."""
    return min(members, key=lambda m: (-len(m.encode()), m))


class Near:
    """Texts by slot, with an upper bound of their similarity to a candidate. A text is a set of (character, how often it came so far), each a bit; Jaro's matches
    are at most the bits that two texts share and those that the text with fewer of them has lost to bits taken twice."""

    WORDS = 8

    def __init__(self):
        self.bit: dict[tuple[str, int], int] = {}
        self.n, self.sets, self.length, self.lost = 0, np.zeros((self.WORDS, 64), "uint64"), np.zeros(64, "float64"), np.zeros(64, "float64")

    def _set(self, text: str) -> tuple[list[int], int]:
        words, seen = [0] * self.WORDS, {}
        for c in text:
            k = seen[c] = seen.get(c, 0) + 1
            bit = self.bit.get((c, k))
            if bit is None:
                bit = (ord(c) * 31 + k) % (64 * self.WORDS)
                if len(self.bit) < 64 * self.WORDS:  # a bit of its own while there are any
                    bit = self.bit[c, k] = len(self.bit)
            words[bit >> 6] |= 1 << (bit & 63)
        return words, len(text) - sum(w.bit_count() for w in words)

    def put(self, slot: int, text: str) -> None:
        if slot == len(self.length):
            self.sets, self.length, self.lost = np.concatenate([self.sets, np.zeros_like(self.sets)], 1), np.concatenate([self.length, np.zeros_like(self.length)]), np.concatenate([self.lost, np.zeros_like(self.lost)])
        words, lost = self._set(text)
        self.sets[:, slot], self.length[slot], self.lost[slot], self.n = words, len(text), lost, max(self.n, slot + 1)

    def slots(self, candidate: str) -> list[tuple[int, float]]:
        """(slot, most matches) of the texts that may reach THRESHOLD; four equal first characters make do with a Jaro similarity of 5/6."""
        words, lost = self._set(candidate)
        most = np.minimum(self.lost[: self.n], lost)
        for own, word in zip(self.sets, words, strict=True):
            if word:
                most += np.bitwise_count(own[: self.n] & np.uint64(word))
        found = np.flatnonzero(most * (self.length[: self.n] + len(candidate)) >= (_matches(4) - 1e-6) * len(candidate) * self.length[: self.n])
        return [(i, float(most[i])) for i in found.tolist()]


def _matches(same: int) -> float:
    """What matches / length of one + matches / length of the other must come to for THRESHOLD, with so many equal first characters."""
    return 3 * (THRESHOLD - 0.1 * same) / (1 - 0.1 * same) - 1


def _may_be(a: str, b: str, most: float) -> bool:
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(len(a), len(b), 4))
    return most * (len(a) + len(b)) >= (_matches(same) - 1e-6) * len(a) * len(b)


def _rank(c: list) -> tuple[int, str]:
    return -c[2], c[3]


class Groups:
    """Clusters of one position: [sorted different members, counts, size, best member], largest first. Beyond FEW clusters, those like a candidate are
    looked for among the ones that Near leaves."""

    FEW = 16

    def __init__(self, start: list[list[tuple[str, int]]] | None = None):
        self.clusters: list[list] = []
        self.near: Near | None = None
        self.slots: list[list] = []
        for members in start or []:
            counts: dict[str, int] = {}
            for text, n in members:
                counts[text] = counts.get(text, 0) + n
            if counts:
                self.clusters.append([sorted(counts), counts, sum(counts.values()), best_of(list(counts))])
        self.clusters.sort(key=_rank)

    def _place(self, c: list) -> int:
        at = bisect_left(self.clusters, _rank(c), key=_rank)
        while self.clusters[at] is not c:
            at += 1
        return at

    def _find(self, candidate: str) -> tuple[int | None, int | None]:
        """Place and slot of the first cluster whose smallest member is like the candidate."""
        if not candidate or len(self.clusters) <= self.FEW:
            return next((i for i, c in enumerate(self.clusters) if _alike(c[0][0], candidate) >= THRESHOLD), None), None
        if self.near is None:
            self.near, self.slots = Near(), list(self.clusters)
            for i, c in enumerate(self.slots):
                self.near.put(i, c[0][0])
        left = [(self._place(self.slots[i]), i) for i, most in self.near.slots(candidate) if _may_be(self.slots[i][0][0], candidate, most)]
        return next(((at, i) for at, i in sorted(left) if _alike(self.clusters[at][0][0], candidate) >= THRESHOLD), (None, None))

    def insert(self, candidate: str) -> None:
        """Into the first cluster whose smallest member is like the candidate, else into a new one."""
        at, slot = self._find(candidate)
        if at is None:
            c, slot = [[candidate], {candidate: 1}, 1, candidate], len(self.slots)
            if self.near:
                self.near.put(slot, candidate)
                self.slots.append(c)
        else:
            c = self.clusters.pop(at)
            if candidate not in c[1]:
                insort(c[0], candidate)
                c[1][candidate] = 0
                c[3] = best_of([c[3], candidate])
                if self.near and c[0][0] == candidate:
                    self.near.put(next(i for i, x in enumerate(self.slots) if x is c) if slot is None else slot, candidate)
            c[1][candidate] += 1
            c[2] += 1
        insort(self.clusters, c, key=_rank)  # after its equals, as it came later

    def members(self) -> list[list[tuple[str, int]]]:
        """The clusters' different texts in order, with their counts."""
        return [[(m, c[1][m]) for m in c[0]] for c in self.clusters]

    def winner(self) -> str:
        """Of the largest clusters the one with the longest best member, then the smallest."""
        best = min(self.clusters, key=lambda c: (-c[2], -len(c[3].encode()), c[3]), default=None)
        return best[3] if best else ""


#: Clusters as texts with counts; spelled out vote by vote only where a stored form wants it.
GROUPS = "array<array<struct<text: string, count: int>>>"
_POSITION = pa.schema([("group_id", pa.string()), ("page", pa.int32()), ("line_index", pa.int32()), ("winner", pa.string()), ("largest", pa.int32()), ("total", pa.int32())])
_GROUPS = pa.schema([("groups", pa.list_(pa.list_(pa.struct([("text", pa.string()), ("count", pa.int32())]))))])
_AT_CUT = pa.schema([("at_cut", pa.bool_())])
_COUNTED = pa.schema([("applied_events", pa.int64()), ("skipped_events", pa.int64()), ("first_timestamp", pa.int64()), ("first_id", pa.string())])
_RESUMED = pa.schema([("early_events", pa.int64()), ("late_events", pa.int64()), ("resumed_largest", pa.int32()), ("resumed_total", pa.int32()), ("same", pa.bool_())])


def _nested(groups: list[list[list[tuple[str, int]]]]) -> pa.Array:
    """Clusters of many positions as a column."""
    outer, inner, texts, counts = [0], [0], [], []
    for clusters in groups:
        for members in clusters:
            texts += [t for t, _ in members]
            counts += [n for _, n in members]
            inner.append(len(texts))
        outer.append(len(inner) - 1)
    leaf = pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(counts, pa.int32())], fields=list(_GROUPS.field(0).type.value_type.value_type))
    return pa.ListArray.from_arrays(pa.array(outer, pa.int32()), pa.ListArray.from_arrays(pa.array(inner, pa.int32()), leaf))


def _sizes(g: Groups) -> tuple[int, int]:
    """Votes of the largest cluster and of all."""
    return max((c[2] for c in g.clusters), default=0), sum(c[2] for c in g.clusters)


def _stream(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (group_id, page, line_index, t, g, late, applied, timestamp, id) in order, to a row per position. Where schema has at_cut, the state before a
    position's first late row is given too, where late isn't null; where it wants the resumed state, one goes on from the stored form of that state. winner, largest and total are null for a position with neither votes nor groups."""
    wanted, done = set(schema.names), {name: [] for name in schema.names}
    resumes, cuts, before = "same" in wanted, "at_cut" in wanted, False
    key, g, alone, h = None, None, None, None
    applied_n = skipped_n = late_n = 0
    first_at = first_id = None

    def give(at_cut: bool = False) -> None:
        if g is not None:
            winner, (largest, total), members = g.winner(), _sizes(g), g.members() if resumes or "groups" in wanted else None
        elif alone is not None:
            winner, largest, total, members = alone, 1, 1, [[(alone, 1)]]
        else:
            winner, largest, total, members = None, None, None, []
        row = {"group_id": key[0], "page": key[1], "line_index": key[2], "winner": winner, "largest": largest, "total": total, "groups": members, "at_cut": at_cut, "applied_events": applied_n, "skipped_events": skipped_n, "first_timestamp": first_at, "first_id": first_id}
        if resumes:
            own = (largest, total) if h is None else _sizes(h)
            row |= {"early_events": applied_n - late_n, "late_events": late_n, "resumed_largest": own[0], "resumed_total": own[1], "same": h is None or h.members() == members}
        for name, values in done.items():
            values.append(row[name])

    def close() -> None:
        if key is not None:
            if before:
                give(True)
            give()

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_nested(done[f.name]) if f.name == "groups" else pa.array(done[f.name], f.type) for f in schema], schema=schema)

    for batch in batches:
        for group, page, line, value, start, late, applied, at, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key is None or line != key[2] or page != key[1] or group != key[0]:
                close()
                key, g, alone, h, applied_n, skipped_n, late_n, first_at, first_id = (group, page, line), None, None, None, 0, 0, 0, None, None
                before = cuts and late is not None and not late
            if start is not None:
                g = Groups([[(m["text"], m["count"]) for m in c] for c in start])
                continue
            if not applied:
                skipped_n += 1
                continue
            if not applied_n:
                first_at, first_id = at, name
            applied_n += 1
            if late:
                if before:
                    give(True)
                    before = False
                if resumes and not late_n and (g is not None or alone is not None):  # else both go on from nothing
                    h = Groups(g.members() if g is not None else [[(alone, 1)]])
                late_n += 1
            if not value:
                continue
            if h is not None:
                h.insert(value)
            if g is not None:
                g.insert(value)
            elif alone is None:
                alone = value
            else:
                g = Groups([[(alone, 1)]])
                g.insert(value)
        if len(done["group_id"]) > 5000:
            yield flush()
            done = {name: [] for name in schema.names}
    close()
    yield flush()


def once(df: DataFrame, *columns: Column) -> DataFrame:
    """Adds columns that are computed once a row: filters on them aren't pushed below, where they would compute them again."""
    made = F.explode(F.array(F.struct(*columns))).alias("_once")
    return df.select("*", made).select(*df.columns, "_once.*")


def _ordered(rows: DataFrame, order: list[Column], applied: Column, late: Column) -> DataFrame:
    return rows.select("group_id", "page", "line_index", "t", F.struct(*order).alias("o"), F.lit(None).cast(GROUPS).alias("g"), late.alias("late"), applied.alias("applied"), F.lit(1).alias("rank"))


def _folded(rows: DataFrame, seed: DataFrame | None, schema: pa.Schema) -> DataFrame:
    if seed is not None:
        none = {c: F.lit(None).cast(rows.schema[c].dataType) for c in ("o", "late", "applied")}
        rows = rows.unionByName(seed.select("group_id", "page", "line_index", F.lit("").alias("t"), F.coalesce("groups", F.array().cast(GROUPS)).alias("g"), *(c.alias(k) for k, c in none.items()), F.lit(0).alias("rank")))
    spread = rows.repartition("group_id", "page", "line_index").sortWithinPartitions("group_id", "page", "line_index", "rank", "o", "t")
    o = F.col("o") if "first_id" in schema.names else {"timestamp": F.lit(None), "id": F.lit(None)}
    given = spread.select("group_id", "page", "line_index", "t", "g", "late", "applied", o["timestamp"].cast("bigint").alias("timestamp"), o["id"].cast("string").alias("id"))
    return given.mapInArrow(lambda batches: _stream(batches, schema), from_arrow_schema(schema))


def fold(lines: DataFrame, order: list[Column], seed: DataFrame | None = None, late: Column | None = None) -> DataFrame:
    """(group_id, page, line_index, winner, largest, total, groups, at_cut) of lines (group_id, page, line_index, text), taken up by order; ties by
    the text. Texts that normalize to nothing don't vote. seed: groups (group_id, page, line_index, groups) to go on from. late: whether a line comes
    after a cut (lines before it come first in order); positions with earlier lines then have a second row, at_cut, with their state there."""
    rows = lines.where("group_id is not null and page is not null and line_index is not null and text is not null")
    rows = once(rows, text.plain(F.col("text")).alias("t")).where("t <> ''")
    return _folded(_ordered(rows, order, F.lit(True), F.lit(None).cast("boolean") if late is None else late), seed, pa.schema([*_POSITION, *_GROUPS, *_AT_CUT]))


def fold_events(lines: DataFrame, seed: DataFrame | None = None, late: Column | None = None, groups: bool = True) -> DataFrame:
    """fold of lines (group_id, page, line_index, text, timestamp, id, applied), all of which are counted in the same pass: applied_events, skipped_events, and
    first_timestamp and first_id of the first applied line. Positions whose lines all don't vote are there with a null total. late: whether a line comes after
    a cut (lines before it come first in order); then also early_events and late_events, and of a state that goes on from the one at the cut,
    resumed_largest, resumed_total and whether its clusters are the same. groups: whether they are wanted."""
    rows = lines.withColumn("t", F.when(F.col("applied"), text.plain(F.col("text"))).otherwise(""))
    rows = _ordered(rows, [F.col("timestamp"), F.col("id")], F.col("applied"), F.lit(False) if late is None else late)
    return _folded(rows, seed, pa.schema([*_POSITION, *(_GROUPS if groups else ()), *_COUNTED, *(_RESUMED if late is not None else ())]))


def spelled(groups: Column) -> Column:
    """Clusters with every member as often as it was read: array<array<string>>."""
    return F.transform(groups, lambda c: F.flatten(F.transform(c, lambda m: F.array_repeat(m["text"], m["count"]))))


def convergence(largest: str = "largest", total: str = "total") -> Column:
    """An aggregate over positions: mean share of the largest cluster, each floored; positions without votes don't count."""
    share = F.when(F.col(total) > 0, F.floor(F.col(largest) * F.lit(10_000) / F.col(total)))
    return F.floor(F.sum(share) / F.count(share)).cast("int")


def metrics(folded: DataFrame) -> DataFrame:
    """(group_id, convergence_bps, ambiguity_bps) of the documents with votes."""
    got = folded.where("total > 0").groupBy("group_id").agg(convergence().alias("convergence_bps"))
    return got.withColumn("ambiguity_bps", F.lit(10_000) - F.col("convergence_bps"))


def pages(folded: DataFrame) -> DataFrame:
    """(group_id, page_no, line_no, text): winners by the ordinal of their page and of their line in it."""
    from evenfold.operators.snapshots import page_ordinals

    line = F.row_number().over(Window.partitionBy("group_id", "page").orderBy("line_index"))
    rows = folded.select("group_id", "page", line.alias("line_no"), F.col("winner").alias("text"))
    return rows.join(page_ordinals(folded), ["group_id", "page"]).select("group_id", "page_no", "line_no", "text")
