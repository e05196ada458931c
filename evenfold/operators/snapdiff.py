"""What changed between full exports (problem 6).

Every key has a persistent ordinal: its hash bucket and its place in the bucket,
which a later export's new keys never change. An export is a compressed bitmap of the
ordinals alive in it, so additions and removals are AND-NOT of two bitmaps; digests of
the content stand in vectors by ordinal, so changes among the common keys are one vector
comparison. A unit of work is one bucket of one pair of neighbouring exports.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenfold.functions.ids import plain_uuid
from evenfold.session import cut
from evenfold.sources import files

#: A dictionary's buckets, always the same number, as ordinals are kept. One of a billion keys has a million in each, whose bitmaps, vectors and names
#: of two exports take about 100 MB.
BUCKETS = 1024


def pack(alive: np.ndarray) -> bytes:
    """A bitmap of booleans, packed eight to a byte and deflated."""
    return zlib.compress(np.packbits(alive).tobytes(), 1)


def unpack(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8), count=n).astype(bool)


def and_not(a: bytes, b: bytes) -> bytes:
    """The bits of a that b lacks, both packed, of the same length."""
    x, y = (np.frombuffer(zlib.decompress(d), np.uint8) for d in (a, b))
    return zlib.compress((x & ~y).tobytes(), 1)


def set_digest(rows: DataFrame, by: str, items: Column) -> DataFrame:
    """(by, d1, d2, n): 128 bits and the size of each group's set of items, whatever their order and copies. Items are moved as
    their hashes."""
    x = F.to_json(items)
    one = rows.select(by, F.xxhash64(x).alias("h1"), F.xxhash64(F.reverse(x), F.lit(7)).alias("h2")).distinct()
    return one.groupBy(by).agg(F.bit_xor("h1").alias("d1"), F.bit_xor("h2").alias("d2"), F.count(F.lit(1)).alias("n"))


def ordinals(keys: DataFrame, known: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(key, bucket, ordinal): known keys keep their ordinals, new ones take the next in their bucket, in order of export_no (if keys has it) and key; so a
    dictionary made of all exports at once is the one that grows with them. The bucket count must stay the same for a dictionary that is kept."""
    when = F.min("export_no") if "export_no" in keys.columns else F.lit(0)
    keys = keys.where("key is not null").groupBy("key").agg(when.alias("since"))
    if known is not None:
        keys = keys.join(known.select("key"), "key", "left_anti")
    fresh = keys.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    fresh = fresh.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy("since", "key")) - 1)
    if known is None:
        return fresh.select("key", "bucket", F.col("r").cast("int").alias("ordinal"))
    top = known.groupBy("bucket").agg((F.max("ordinal") + 1).alias("base"))
    fresh = fresh.join(top, "bucket", "left").select("key", "bucket", (F.col("r") + F.coalesce("base", F.lit(0))).cast("int").alias("ordinal"))
    return known.select("key", "bucket", "ordinal").unionByName(fresh)


_CHANGE = pa.schema([("export_no", pa.int32()), ("key", pa.string()), ("change_kind", pa.string())])


def _compare(table: pa.Table) -> pa.Table:
    """One bucket of one pair of exports: rows (pair, now, key, ordinal, d1, d2, n)."""
    now, ordinal = table["now"].to_numpy(), table["ordinal"].to_numpy()
    size = int(ordinal.max()) + 1
    keys = np.empty(size, object)
    keys[ordinal] = table["key"].to_numpy(zero_copy_only=False)
    bitmaps, vectors = [], []
    for side in (False, True):
        here = now == side
        alive = np.zeros(size, bool)
        alive[ordinal[here]] = True
        bitmaps.append(pack(alive))
        vectors.append([np.zeros(size, np.int64) for _ in range(3)])
        for v, c in zip(vectors[-1], ("d1", "d2", "n"), strict=True):
            v[ordinal[here]] = table[c].fill_null(0).to_numpy()[here]
    before, after = bitmaps
    differs = np.logical_or.reduce([x != y for x, y in zip(*vectors, strict=True)])
    hits = {"added": unpack(and_not(after, before), size), "removed": unpack(and_not(before, after), size), "changed": unpack(before, size) & unpack(after, size) & differs}
    pair = table["pair"][0].as_py()
    rows = [(pair, k, kind) for kind, hit in hits.items() for k in keys[hit]]
    return pa.table({f.name: pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_CHANGE)}, schema=_CHANGE)


def diff(exports: DataFrame, known: DataFrame | None = None, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """((export_no, key, change_kind), dictionary) from rows (export_no, key, d1, d2, n), one per key and export: each export against the one
    before, in order of export_no. known is the dictionary of earlier runs; the one returned has all keys and is to be kept. Rows without export_no or
    key are no record; a missing digest is the digest of nothing."""
    exports = cut(exports.where("export_no is not null and key is not null"))
    numbers = sorted(r.export_no for r in exports.select("export_no").distinct().collect())  # one per export
    dictionary = cut(ordinals(exports, known, buckets))
    pairs = {n: [*([(n, True)] if i else []), *([(numbers[i + 1], False)] if i + 1 < len(numbers) else [])] for i, n in enumerate(numbers)}
    sides = exports.sparkSession.createDataFrame([(n, p, now) for n, of in pairs.items() for p, now in of], "export_no int, pair int, now boolean")
    placed = exports.join(F.broadcast(sides), "export_no").join(dictionary, "key")  # sides has two rows per export
    cols = ["pair", "now", "key", "ordinal", "d1", "d2", "n"]
    return placed.select("bucket", *cols).groupBy("bucket", "pair").applyInArrow(_compare, "export_no int, key string, change_kind string"), dictionary


def exports_of(snapshots: DataFrame, lines: DataFrame) -> DataFrame:
    """(export_no, key, d1, d2, n) of document_snapshots with the texts of snapshot_lines. A document that stands in an export with several snapshots has
    the one created last (then the one with the greatest id); a snapshot without lines has the empty set."""
    heads = snapshots.select(F.col("export_no").cast("int"), plain_uuid("document_id").alias("key"), plain_uuid("snapshot_id").alias("snapshot_id"), "created_at")
    heads = heads.where("export_no is not null and key is not null").groupBy("export_no", "key").agg(F.max(F.struct("created_at", "snapshot_id")).alias("h"))
    digests = set_digest(lines.select(plain_uuid("snapshot_id").alias("snapshot_id"), "page", "line", "text"), "snapshot_id", F.struct("page", "line", "text"))
    return heads.select("export_no", "key", F.col("h.snapshot_id").alias("snapshot_id")).join(digests, "snapshot_id", "left").drop("snapshot_id")


def document_changes(snapshots: DataFrame, lines: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(export_no, document_id, change_kind) of the exports of document_snapshots."""
    return diff(exports_of(snapshots, lines), known)[0].withColumnRenamed("key", "document_id")


def load_dictionary(spark: SparkSession, root: str) -> DataFrame | None:
    """The dictionary that was stored last under a folder; None if none was."""
    seen = [n for n in files.names(spark, root) if n.startswith("v")]
    return spark.read.parquet(f"{root}/{seen[-1]}") if seen else None


def store_dictionary(dictionary: DataFrame, root: str) -> None:
    """Keeps a dictionary as the newest one of the folder. It is written beside the others and renamed, so a lost attempt leaves nothing that load would take."""
    spark = dictionary.sparkSession
    seen = [n for n in files.names(spark, root) if n.startswith("v")]
    draft = f"{root}/_draft-{uuid.uuid4().hex}"
    dictionary.write.parquet(draft)
    files.move(spark, draft, f"{root}/v{int(seen[-1][1:]) + 1 if seen else 1:09d}")
