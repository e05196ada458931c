"""From images or readings to snapshots: the whole plan for any number of documents in one job."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenfold.functions import scoring
from evenfold.functions.ids import NAMESPACE_URL, uuid5
from evenfold.operators import image, plurality, roi, snapshots, weighted
from evenfold.schema import DEFAULT, Profile
from evenfold.session import cut
from evenfold.sources import store, text


@dataclass
class Result:
    """documents and positions are the state after refinement, which the snapshots and observations are made from; reduced has the positions before."""

    raw_observations: DataFrame
    documents: DataFrame
    positions: DataFrame
    reduced: DataFrame
    regions: DataFrame
    snapshots: DataFrame
    observations: DataFrame


def read_documents(images: DataFrame, lang: str, provider: Callable[[bytes, str, str], str] = text.tesseract, variants: tuple[str, ...] = image.VARIANTS) -> DataFrame:
    """(source, variant, text) of gray images (image_id, width, height, pixels): every image in every variant, written as PNG and read by the provider."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pixels = [image.png(np.frombuffer(p, np.uint8).reshape(h, w)) for p, w, h in zip(b["pixels"], b["width"], b["height"], strict=True)]
            yield pd.DataFrame({"source": b["image_id"], "variant": b["variant"], "content": pixels})

    made = image.variants(images, variants).select("image_id", "variant", "width", "height", "pixels")
    return text.read_images(made.mapInPandas(encode, "source string, variant string, content binary"), lang, provider)


def process(readings: DataFrame, created_at: Column, profile: Profile = DEFAULT, source_mode: str = "distinct", roi_from: str = "alternatives", padding: int = 2) -> Result:
    """readings: (source, variant, text), one row per reading of a document; a document is its source. Where a variant
    was read more than once, a column reading tells its readings apart, and each votes. Ids are made from the content, so a retry
    gives the same ones. Documents with numeric conflicts are planned for reading again, and what the plan's regions hold is folded into their state
    by the counted reducer, which then settles all their positions. roi_from: alternatives looks at all clusters of a position, clusters only within one."""
    own = F.concat(F.coalesce("variant", F.lit("")), F.lit("#"), "reading") if "reading" in readings.columns else F.col("variant")
    readings = readings.withColumns({"kind": F.col("variant"), "variant": own})
    lines = text.to_lines(readings.where("source is not null"), ["source", "variant", "kind"]).withColumns({"group_id": F.col("source"), "page": F.lit(1), "confidence": F.lit(None).cast("float")})
    normal = cut(text.normalize(lines, profile))  # voted on, read again and kept as raw text
    documents, positions = weighted.reduce_documents(normal, profile.similarity_threshold, source_mode)
    # whatever sources the votes had, the document is the file
    documents = documents.withColumns({"source": F.col("group_id"), "document_id": uuid5(NAMESPACE_URL, F.col("group_id"))})
    by = ["source", "variant"]
    raw = text.to_text(lines, [*by, "kind"]).withColumnRenamed("text", "raw_text").join(text.to_text(normal, by).withColumnRenamed("text", "normalized_text"), by, "left")
    used = F.struct(*(F.lit(v).alias(k) for k, v in profile.as_dict().items()))
    raw = raw.select(
        uuid5(NAMESPACE_URL, F.concat_ws("#", F.lit("observation"), "source", "variant", "raw_text")).alias("observation_id"), uuid5(NAMESPACE_URL, F.col("source")).alias("document_id"),
        "source", F.col("kind").alias("variant"), created_at.alias("created_at"), "raw_text", F.coalesce("normalized_text", F.lit("")).alias("normalized_text"), used.alias("profile_used"),
    )
    regions = cut(plan_regions(documents, positions, roi_from, padding))
    refined_documents, refined = refine(documents, positions, regions, normal.withColumn("variant", F.col("kind")))
    heads = snapshots.snapshots(refined_documents, refined, uuid5(NAMESPACE_URL, F.concat(F.lit("snapshot#"), F.col("group_id"))), created_at)
    found = snapshots.observations(refined_documents, uuid5(NAMESPACE_URL, F.concat(F.lit("finding#"), F.col("group_id"))), created_at)
    return Result(raw, refined_documents, refined, positions, regions, heads, found)


def plan_regions(documents: DataFrame, positions: DataFrame, roi_from: str = "alternatives", padding: int = 2) -> DataFrame:
    """Regions to read again of the documents in which a numeric veto fired."""
    gated = positions.join(documents.where("numeric_conflicts > 0").select("group_id"), "group_id", "left_semi")
    if roi_from == "alternatives":
        rois = roi.numeric_alternatives(gated)
    else:
        rois = roi.numeric_conflicts(gated.select("group_id", "page", (F.col("line") - 1).alias("line_index"), snapshots.groups_of(F.col("clusters")).alias("groups")))
    return roi.merge(rois, padding)


def refine(documents: DataFrame, positions: DataFrame, regions: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, positions) after the regions' lines (group_id, page, variant, line, text) were folded in. A document with regions has one iteration more, its
    positions' winners and its scores by counts; the others stay as they are. positions have groups, and no convergence where they were counted."""
    touched = regions.select("group_id").distinct()
    again = roi.refine(regions, lines)
    kept = positions.withColumn("groups", snapshots.groups_of(F.col("clusters")))
    seed = kept.join(touched, "group_id", "left_semi").select("group_id", "page", (F.col("line") - 1).alias("line_index"), "groups")
    counted = cut(plurality.fold(again.select("group_id", "page", (F.col("line") - 1).alias("line_index"), "text"), [F.col("text")], seed).drop("at_cut"))
    cols = ["group_id", "page", "line", "winner", "convergence_bps", "groups"]
    new = counted.select("group_id", "page", (F.col("line_index") + 1).alias("line"), "winner", F.lit(None).cast("int").alias("convergence_bps"), "groups")
    state = kept.join(touched, "group_id", "left_anti").select(*cols).unionByName(new.select(*cols))
    sizes = counted.groupBy("group_id").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("page").alias("_p")).join(plurality.metrics(counted).select("group_id", F.col("convergence_bps").alias("_c"), F.col("ambiguity_bps").alias("_a")), "group_id")
    hit = F.col("_n").isNotNull()
    pick = lambda new_, old: F.when(hit, F.col(new_)).otherwise(F.col(old)).alias(old)
    joined = documents.join(sizes, "group_id", "left")
    changed = {"n_positions": pick("_n", "n_positions"), "n_pages": pick("_p", "n_pages"), "convergence_bps": pick("_c", "convergence_bps"), "ambiguity_bps": pick("_a", "ambiguity_bps"), "iterations": (F.col("iterations") + hit.cast("int")).alias("iterations")}
    out = joined.select(*(changed.get(c, F.col(c)) for c in documents.columns))
    return out.withColumn("status", scoring.status(F.col("n_pages"), F.col("convergence_bps"), F.col("ambiguity_bps"))), state


def persist(result: Result, root: str) -> None:
    """Raw readings first, then what was derived from them. Appends, so runs over the same readings repeat their ids; read with store.latest."""
    to = store.Store(result.documents.sparkSession, root)
    to.append("raw_observations", result.raw_observations)
    to.append("snapshots", result.snapshots)
    to.append("observations", result.observations)
