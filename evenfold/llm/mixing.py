"""Mixing sources to target shares (problem 9).

Documents are counted by source and exact token length. A source's quota is met
by whole rounds of all its documents and a rest; the rest is a subset-sum
problem over lengths: an even part of every length first, then a bounded
knapsack by dynamic programming over what is left. Which documents of a length are taken is
decided by a seeded hash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenfold.session import cut

#: Budgets up to this many tokens are fitted exactly by dynamic programming; what lies above is filled evenly.
EXACT = 1 << 16
BUCKETS = 1024


@lru_cache(maxsize=2)
def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("mixing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def count_tokens(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens); a null text has no tokens. The vocabulary's path must exist on every executor."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return documents.select(F.col("doc_id").cast("long"), "source", "text").where("doc_id is not null").mapInArrow(run, "doc_id long, source string, n_tokens long")


def knapsack(budget: int, counts: dict[int, int]) -> dict[int, int]:
    """How many of each length to take so that the sum comes as near to budget as it can without passing it.
    reach has a bit for each sum that can be made; it is kept after each step, to walk back."""
    steps: list[tuple[int, int]] = []
    reach, mask = [1], (1 << budget + 1) - 1
    for length in sorted(counts, reverse=True):
        left, size = min(counts[length], budget // length), 1
        while left > 0:
            n = min(size, left)
            steps.append((length, n))
            reach.append(reach[-1] | (reach[-1] << length * n) & mask)
            left, size = left - n, size * 2
        if reach[-1] >> budget & 1:
            break
    at, took = reach[-1].bit_length() - 1, {}
    for k in range(len(steps), 0, -1):
        if not reach[k - 1] >> at & 1:
            length, n = steps[k - 1]
            took[length] = took.get(length, 0) + n
            at -= length * n
    return took


def fit(budget: int, counts: dict[int, int]) -> dict[int, int]:
    """How many documents of each length add up to budget, or as near below as can be found. Every length gives its even part
    first; longest lengths bring the rest down to EXACT, which knapsack fits."""
    total = sum(n * c for n, c in counts.items())
    if total <= budget:
        return dict(counts)
    spare = max(0, budget - EXACT // 2)
    took = {n: c * spare // total for n, c in counts.items()}
    left = budget - sum(n * c for n, c in took.items())
    for n in sorted(counts, reverse=True):
        if left <= EXACT:
            break
        more = min(counts[n] - took[n], (left - EXACT) // n + 1, left // n)
        took[n] += more
        left -= more * n
    for n, c in knapsack(left, {n: counts[n] - took[n] for n in counts if counts[n] > took[n]}).items():
        took[n] += c
    return took


def plan(histogram: list[tuple[str, int, int]], targets: list[tuple[str, float, int]], total: int | None = None) -> dict[str, tuple[int, dict[int, int]]]:
    """By source: whole rounds, and how many documents of each length come once more. Without total, the mixture is the
    largest one in which every source with documents reaches its share within its repeats; shares are taken over those sources."""
    counts: dict[str, dict[int, int]] = {}
    for source, n, c in histogram:
        if n > 0:
            counts.setdefault(source, {})[n] = c
    tokens = {s: sum(n * c for n, c in by.items()) for s, by in counts.items()}
    live = [(s, share, most) for s, share, most in targets if s in tokens and share and share > 0 and most and most > 0]
    if not live:
        return {}
    whole = sum(share for _, share, _ in live)
    if total is None:
        total = int(min(most * tokens[s] / (share / whole) for s, share, most in live))
    out = {}
    for s, share, most in live:
        quota = min(int(total * share / whole + 0.5), most * tokens[s])
        rounds = quota // tokens[s]
        out[s] = (rounds, fit(quota - rounds * tokens[s], counts[s]) if rounds < most else {})
    return out


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 42, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, copies): every document with how often it is used; 0 for sources without a target (and for null
    sources), and for documents without tokens. A source's histogram has one row per token length and is all that the driver sees."""
    counted = cut(count_tokens(documents, vocabulary))
    wanted = [(r.source, r.target_share, r.max_repeats) for r in targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).collect()]  # one per source
    known = counted.where(F.col("source").isin([w[0] for w in wanted]))
    histogram = [(r.source, r.n_tokens, r.n) for r in known.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()]
    chosen = plan(histogram, wanted, total)
    spark = documents.sparkSession
    rounds = spark.createDataFrame([(s, r) for s, (r, _) in chosen.items()], "source string, rounds int")
    extra = spark.createDataFrame([(s, n, c) for s, (_, took) in chosen.items() for n, c in took.items() if c], "source string, n_tokens long, take long")
    rows = counted.withColumn("_h", F.xxhash64("doc_id", F.lit(seed))).withColumn("_b", F.pmod("_h", F.lit(BUCKETS)).cast("int"))
    picked = _take(rows, extra)
    out = rows.join(F.broadcast(rounds), "source", "left").join(picked, ["doc_id"], "left")  # rounds has a row per source of the targets
    copies = F.when(F.col("n_tokens") > 0, F.coalesce("rounds", F.lit(0)) + F.coalesce("one", F.lit(0))).otherwise(0)
    return out.select("doc_id", "source", "n_tokens", copies.cast("int").alias("copies"))


def _take(rows: DataFrame, extra: DataFrame) -> DataFrame:
    """(doc_id, one): the first `take` documents by hash of each source and length. Buckets of the hash that lie wholly below the
    limit are taken whole; only the bucket in which the limit falls is ranked, so a hot length meets in no single task."""
    key = ["source", "n_tokens"]
    sized = rows.join(extra, key).groupBy(*key, "_b", "take").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*key).orderBy("_b"))  # at most BUCKETS rows
    limits = sized.withColumn("upto", upto).where(F.col("upto") - F.col("n") < F.col("take")).select(*key, "_b", (F.col("take") - F.col("upto") + F.col("n")).alias("need"), "n")
    hit = rows.join(limits, [*key, "_b"])
    whole = hit.where("need >= n").select("doc_id")
    rank = F.row_number().over(Window.partitionBy(*key, "_b").orderBy("_h", "doc_id"))
    part = hit.where("need < n").withColumn("_k", rank).where("_k <= need").select("doc_id")
    return whole.unionByName(part).withColumn("one", F.lit(1))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, n_docs, n_used, n_tokens, used_tokens, most_copies): what a mixture reached."""
    by = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("copies").alias("n_used"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"),
    )
    total = by.agg(F.sum("used_tokens").alias("total"))
    got: Column = F.when(F.col("total") > 0, F.col("used_tokens") / F.col("total")).otherwise(0.0)
    return by.join(targets.select("source", "target_share"), "source", "full").join(F.broadcast(total)).select("source", "target_share", got.alias("actual_share"), "n_docs", "n_used", "n_tokens", "used_tokens", "most_copies")
