"""The batch reducer: weighted votes on every position of a document.

lines -> votes -> one vote per key and source -> clusters per position -> scores
per position -> scores per document. Positions are independent of each other,
so a document is spread over as many tasks as it has positions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenfold.functions import scoring, text
from evenfold.functions.ids import NAMESPACE_URL, NIL_UUID, uuid5
from evenfold.functions.similarity import jaro_winkler
from evenfold.session import cut

POSITION = ["group_id", "page", "line"]
#: A lead of less than this share of the weight is a weak one.
WEAK_MARGIN = 750
_EPSILON = np.finfo(np.float32).eps


def votes(lines: DataFrame) -> DataFrame:
    """(group_id, page, line, key, variant, weight, source): one vote per line that isn't empty once it is cleaned. A null
    text is no vote; a null source is the empty one; rows without a position are left out."""
    rows = lines.where("group_id is not null and page is not null and line is not null and text is not null")
    rows = rows.select(*POSITION, text.vote_variant(F.col("text")).alias("variant"), scoring.weight(F.col("confidence")).alias("weight"), F.coalesce("source", F.lit("")).alias("source"))
    return rows.where("variant <> ''").select(*POSITION, F.lower("variant").alias("key"), "variant", "weight", "source")


def single_votes(voted: DataFrame) -> DataFrame:
    """One vote per position, key and source: the smallest variant, then the greatest weight."""
    first = F.min(F.struct("variant", (-F.col("weight")).alias("w"))).alias("f")
    return voted.groupBy(*POSITION, "key", "source").agg(first).select(*POSITION, "key", "source", F.col("f.variant").alias("variant"), (-F.col("f.w")).cast("float").alias("weight"))


@lru_cache(maxsize=100_000)
def _traits(key: str) -> tuple[bool, bool, tuple[str, ...]]:
    """Cyrillic, negated, numbers."""
    return bool(re.search("[Ѐ-ӿ]", key)), "non" in key.split(), tuple(re.findall(r"[0-9.]*[0-9][0-9.]*", key))


#: Equal votes of one position, and the same key on many, ask again.
_alike = lru_cache(maxsize=100_000)(jaro_winkler)


def _bps(part: np.float32, total: np.float32) -> int:
    if total <= 0:
        return 0
    return int(min(max(np.floor(np.float32(part / total) * np.float32(10_000) + np.float32(0.5)), 0), 10_000))


class Cluster:
    """Votes taken for one text. The key is that of its first vote."""

    __slots__ = ("count", "key", "text", "variants", "weight")

    def __init__(self, key: str, variant: str, weight: np.float32):
        self.key, self.text, self.weight, self.count = key, variant, weight, 1
        self.variants = {variant: [weight, 1]}

    def add(self, variant: str, weight: np.float32) -> None:
        self.weight = np.float32(self.weight + weight)
        self.count += 1
        v = self.variants.setdefault(variant, [np.float32(0), 0])
        v[0], v[1] = np.float32(v[0] + weight), v[1] + 1
        # heaviest, then most frequent, then smallest
        self.text = min(self.variants, key=lambda t: (-self.variants[t][0], -self.variants[t][1], t))


class Position:
    """Clusters of one position, ranked after every vote: the rank decides between clusters that are equally like the next vote."""

    def __init__(self, threshold: float):
        self.threshold, self.clusters = threshold, []
        self.merges = self.negations = self.numerics = self.total = 0

    def vote(self, key: str, variant: str, weight: np.float32) -> None:
        self.total += 1
        best, like, vetoed = None, -1.0, ""
        for c in self.clusters:
            sim = _alike(c.key, key)
            if sim < self.threshold:
                continue
            (cyr, neg, num), (cyr2, neg2, num2) = _traits(c.key), _traits(key)
            if cyr != cyr2:
                continue
            if neg != neg2:
                vetoed = "negation"
            elif num and num2 and num != num2:
                vetoed = "numeric"
            elif sim > like:
                best, like = c, sim
        if best is not None:
            best.add(variant, weight)
            self.merges += 1
        else:
            self.clusters.append(Cluster(key, variant, weight))
            self.negations += vetoed == "negation"
            self.numerics += vetoed == "numeric"
        self.clusters.sort(key=lambda c: (-c.weight, -c.count, c.text))

    def scores(self) -> tuple[int, int]:
        """Convergence and ambiguity of the leader."""
        w = [c.weight for c in self.clusters]
        total = np.float32(0)
        for x in w:
            total = np.float32(total + x)
        first, second = w[0], w[1] if len(w) > 1 else np.float32(0)
        conv, amb = _bps(first, total), _bps(second, total)
        if total > 0:
            lead = np.float32(first - second)
            margin = _bps(lead, total)
            if abs(lead) < _EPSILON:
                amb = max(amb, conv)
            elif margin < WEAK_MARGIN:
                amb, conv = max(amb, 10_000 - margin), min(conv, 10_000 - WEAK_MARGIN)
        return conv, amb


_OUT = "group_id string, page int, line int, winner string, convergence_bps int, ambiguity_bps int, votes int, collisions int, negation_conflicts int, numeric_conflicts int, clusters array<struct<text: string, total_weight: float, count: int>>"
_OUT_PA = pa.schema([
    ("group_id", pa.string()), ("page", pa.int32()), ("line", pa.int32()), ("winner", pa.string()), ("convergence_bps", pa.int32()), ("ambiguity_bps", pa.int32()),
    ("votes", pa.int32()), ("collisions", pa.int32()), ("negation_conflicts", pa.int32()), ("numeric_conflicts", pa.int32()),
    ("clusters", pa.list_(pa.struct([("text", pa.string()), ("total_weight", pa.float32()), ("count", pa.int32())]))),
])


def _fold(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for group, page, line, cast in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                p = Position(threshold)
                for v in sorted(cast, key=lambda v: (v["key"], v["variant"], -v["weight"])):
                    for _ in range(v["n"]):
                        p.vote(v["key"], v["variant"], np.float32(v["weight"]))
                got = [{"text": c.text, "total_weight": float(c.weight), "count": c.count} for c in p.clusters]
                out.append((group, page, line, p.clusters[0].text, *p.scores(), p.total, p.merges, p.negations, p.numerics, got))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(_OUT_PA)], schema=_OUT_PA)

    return run


def positions(lines: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Clusters and scores of every position. Equal votes are counted before they meet, so however many sources agree, a position has
    one entry per different vote. Positions with one such entry, the most, are settled without Python."""
    one = single_votes(votes(lines))
    same = one.groupBy(*POSITION, "key", "variant", "weight").agg(F.count(F.lit(1)).cast("int").alias("n"))
    cast = same.groupBy(*POSITION).agg(F.collect_list(F.struct("key", "variant", "weight", "n")).alias("cast"))  # different votes on one position
    easy = (F.size("cast") == 1) & (F.col("cast")[0]["n"] <= 64)
    v = F.col("v")
    total = F.aggregate(F.sequence(F.lit(1), v["n"]), F.lit(0.0).cast("float"), lambda acc, _: (acc + v["weight"]).cast("float"))
    sure = cast.where(easy).select(*POSITION, F.col("cast")[0].alias("v")).withColumn("total", total)
    conv = F.when(F.col("total") > 0, 10_000).otherwise(0)
    sure = sure.select(
        *POSITION, v["variant"].alias("winner"), conv.alias("convergence_bps"), F.lit(0).alias("ambiguity_bps"), v["n"].alias("votes"), (v["n"] - 1).alias("collisions"),
        F.lit(0).alias("negation_conflicts"), F.lit(0).alias("numeric_conflicts"),
        F.array(F.struct(v["variant"].alias("text"), F.col("total").alias("total_weight"), v["n"].alias("count"))).alias("clusters"),
    )
    return cast.where(~easy).select(*POSITION, "cast").mapInArrow(_fold(threshold), _OUT).unionByName(sure)


def documents(lines: DataFrame, folded: DataFrame) -> DataFrame:
    """One row per group: source (the least), document_id, iterations (readings before votes are dropped), floored means of the positions'
    scores and the counters. Groups without a vote aren't there."""
    reading = F.struct(F.coalesce("source", F.lit("")).alias("s"), F.coalesce("variant", F.lit("")).alias("v"))
    heads = lines.where("group_id is not null").groupBy("group_id").agg(F.min(F.coalesce("source", F.lit(""))).alias("source"), F.count_distinct(reading).cast("int").alias("iterations"))
    s = lambda c: F.sum(F.col(c).cast("long"))
    sums = folded.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n_positions"), F.count_distinct("page").alias("n_pages"), s("convergence_bps").alias("c"), s("ambiguity_bps").alias("a"), s("votes").alias("total_votes"),
        s("collisions").alias("x"), s("negation_conflicts").alias("negation_conflicts"), s("numeric_conflicts").alias("numeric_conflicts"),
    )
    out = sums.join(heads, "group_id")
    div = lambda a, b: F.floor(a / b).cast("int")
    conv, amb = div(F.col("c"), F.col("n_positions")), div(F.col("a"), F.col("n_positions"))
    return out.select(
        "group_id", F.when(F.col("source") == "", NIL_UUID).otherwise(uuid5(NAMESPACE_URL, F.col("source"))).alias("document_id"), "source", "iterations", "n_pages", "n_positions", "total_votes",
        conv.alias("convergence_bps"), amb.alias("ambiguity_bps"), div(F.col("x") * 10_000, F.col("total_votes")).alias("collision_rate_bps"),
        "negation_conflicts", "numeric_conflicts", (F.col("negation_conflicts") + F.col("numeric_conflicts")).alias("semantic_conflict_count"),
        scoring.status(F.col("n_pages"), conv, amb).alias("status"),
    )


def reduce_documents(lines: DataFrame, threshold: float = 0.90, source_mode: str = "distinct") -> tuple[DataFrame, DataFrame]:
    """(documents, positions). source_mode distinct makes every reading a source of its own; shared keeps the lines' sources, so readings that
    agree count once."""
    if source_mode == "distinct":
        lines = lines.withColumn("source", F.concat(F.coalesce("source", F.lit("")), F.lit("#"), F.coalesce("variant", F.lit(""))))
    folded = cut(positions(lines, threshold))  # read by the documents and by whatever the caller derives from it
    return documents(lines, folded), folded
