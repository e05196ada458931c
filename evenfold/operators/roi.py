"""Regions to read again: positions where readings disagree, merged to line ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenfold.functions.text import differs_in_numbers

#: Reasons in their order, with severity and the variant that is read again.
REASONS = {"NumericConflict": (0, 2, "HighContrast"), "Ambiguity": (1, 1, "HighContrast"), "DenseCluster": (2, 0, "Original")}
VARIANTS = {"HighContrast": "high_contrast", "Original": "original", "Rotated": "rotated"}


def _case(c: Column, to: dict) -> Column:
    out = F
    for k, v in to.items():
        out = out.when(c == k, v)
    return out


def ordinal(reason: Column) -> Column:
    return _case(reason, {r: v[0] for r, v in REASONS.items()})


def severity(reason: Column) -> Column:
    return _case(reason, {r: v[1] for r, v in REASONS.items()})


def hint(reason: Column) -> Column:
    return _case(reason, {r: v[2] for r, v in REASONS.items()})


def variant_for(hint_: Column) -> Column:
    return _case(hint_, VARIANTS)


def numeric_conflicts(groups: DataFrame, line_from: int = 1) -> DataFrame:
    """(group_id, page, line, reason) of positions (group_id, page, line_index from 0, groups) where two neighbours in a cluster, its texts in
    order, differ in their digits alone; each position once. Equal members are no neighbours of note, so counts play no part."""
    hit = F.exists(F.transform("groups", lambda c: F.transform(c, lambda m: m["text"])), lambda c: F.exists(F.sequence(F.lit(1), F.size(c) - 1), lambda i: (F.size(c) > 1) & differs_in_numbers(F.get(c, i - 1), F.get(c, i))))
    # a cluster of one gives the sequence 1, 0 and no second member; a null comparison is no conflict
    rows = groups.where(F.coalesce(hit, F.lit(False)))
    return rows.select("group_id", "page", (F.col("line_index") + line_from).alias("line"), F.lit("NumericConflict").alias("reason")).distinct()


def differs_by_numbers(clusters: Column) -> Column:
    """Whether two ranked alternatives that follow each other differ in their digits alone."""
    c = F.transform(clusters, lambda x: x["text"])
    hit = F.exists(F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1))), lambda i: differs_in_numbers(F.get(c, i - 1), F.get(c, i)))
    return (F.size(c) > 1) & F.coalesce(hit, F.lit(False))


def numeric_alternatives(positions: DataFrame) -> DataFrame:
    """The same from the ranked alternatives of the weighted reducer (group_id, page, line, clusters)."""
    return positions.where(differs_by_numbers(F.col("clusters"))).select("group_id", "page", "line", F.lit("NumericConflict").alias("reason"))


def merge(rois: DataFrame, padding: int = 2) -> DataFrame:
    """Regions (group_id, page, line_start, line_end, dominant_reason, atomic_count, preprocess_hint): positions padded by lines above and below,
    joined where they touch. The most severe reason dominates (the first of equals); the hint is the first position's. Equal rows
    count as often as they stand. Windows run within one page of one document."""
    w = Window.partitionBy("group_id", "page").orderBy("line", "o")
    rows = rois.withColumn("o", ordinal(F.col("reason"))).withColumns({"s": F.greatest(F.lit(0), F.col("line") - padding), "e": F.col("line") + padding})
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("n", F.when(before.isNull() | (F.col("s") > before + 1), 1).otherwise(0)).withColumn("g", F.sum("n").over(w))
    first = F.struct("line", "o")
    return rows.groupBy("group_id", "page", "g").agg(
        F.min("s").alias("line_start"), F.max("e").alias("line_end"), F.min_by("reason", F.struct(-severity(F.col("reason")), "line", "o")).alias("dominant_reason"),
        F.count(F.lit(1)).cast("int").alias("atomic_count"), hint(F.min_by("reason", first)).alias("preprocess_hint"),
    ).drop("g")


def plan(rois: DataFrame, padding: int = 2) -> DataFrame:
    """One row per document: its regions in order, the number of positions, and a hash of both without hints and counts."""
    region = F.struct("page", "line_start", "line_end", "dominant_reason", "preprocess_hint", "atomic_count")
    out = merge(rois, padding).groupBy("group_id").agg(F.array_sort(F.collect_list(region)).alias("regions"), F.sum("atomic_count").cast("int").alias("atomic_count"))
    hashed = F.transform("regions", lambda r: F.struct(r["page"].alias("page"), r["line_start"].alias("line_start"), r["line_end"].alias("line_end"), r["dominant_reason"].alias("dominant_reason")))
    return out.withColumn("plan_hash", F.sha2(F.to_json(F.struct("group_id", "atomic_count", hashed.alias("regions"))), 256))


def refine(regions: DataFrame, lines: DataFrame) -> DataFrame:
    """(group_id, page, line, text): the lines of the hinted variant inside the regions; where regions overlap, the first that has text wins. Regions and
    lines meet by document, page and variant."""
    r = regions.select("group_id", "page", F.greatest("line_start", F.lit(1)).alias("a"), F.col("line_end").alias("b"), variant_for(F.col("preprocess_hint")).alias("variant"))
    got = r.join(lines.where("text <> ''").select("group_id", "page", "variant", "line", "text"), ["group_id", "page", "variant"]).where("line between a and b")
    return got.groupBy("group_id", "page", "line").agg(F.min_by("text", F.struct("a", "b", "text")).alias("text"))
