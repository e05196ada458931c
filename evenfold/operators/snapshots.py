"""Snapshots of reduced documents: projection, content hash, checks, observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenfold.functions import scoring
from evenfold.functions.ids import NAMESPACE_OID, NAMESPACE_URL, NIL_UUID, uuid5
from evenfold.operators.plurality import spelled
from evenfold.schema import DEFAULT, Profile

SCHEMA_VERSION = 1
#: What a stored confidence may differ from the recomputed one.
TOLERANCE = 1e-4


def page_lines(positions: DataFrame) -> DataFrame:
    """(group_id, page, line_no, text, confidence): winners with gaps closed within their page."""
    rank = F.row_number().over(Window.partitionBy("group_id", "page").orderBy("line"))
    return positions.select("group_id", "page", rank.alias("line_no"), F.col("winner").alias("text"), scoring.confidence(F.col("convergence_bps")).alias("confidence"))


def fields(positions: DataFrame) -> DataFrame:
    """(group_id, field, text): page_<page number>_line_<rank in the page>."""
    return page_lines(positions).select("group_id", F.format_string("page_%d_line_%d", "page", "line_no").alias("field"), "text")


def page_ordinals(positions: DataFrame) -> DataFrame:
    """(group_id, page, page_no): pages by their rank in the document; the window sees one row per page."""
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy("page"))
    return positions.select("group_id", "page").distinct().withColumn("page_no", rank)


def snapshot_lines(positions: DataFrame) -> DataFrame:
    """(group_id, page, line, text) by the ordinal of the page and of the line in it."""
    rows = page_lines(positions).join(page_ordinals(positions), ["group_id", "page"])
    return rows.select("group_id", F.col("page_no").alias("page"), F.col("line_no").alias("line"), "text")


def content_hash(document_id: Column, iterations: Column, lines: Column) -> Column:
    """UUID v5 of the canonical JSON: keys in alphabetical order, lines by page, line and text. Copies of lines count."""
    ordered = F.array_sort(F.transform(lines, lambda x: F.struct(x["page"].alias("page"), x["line"].alias("line"), x["text"].alias("text"))))
    out = F.transform(ordered, lambda x: F.struct(x["line"].alias("line"), x["page"].alias("page"), x["text"].alias("text")))
    return uuid5(NAMESPACE_OID, F.to_json(F.struct(document_id.alias("document_id"), iterations.alias("iterations"), out.alias("lines"))))


def groups_of(clusters: Column) -> Column:
    """The weighted reducer's clusters as those of the counted one: each with its winner alone."""
    return F.transform(clusters, lambda c: F.array(F.struct(c["text"].alias("text"), c["count"].alias("count"))))


def cluster_groups(positions: DataFrame) -> DataFrame:
    """(group_id, cluster_groups map<page, map<line from 0, array<array<string>>>>), the stored form: each cluster's members as often as they have votes, of
    a position's groups or else of its clusters' winners."""
    groups = spelled(F.col("groups") if "groups" in positions.columns else groups_of(F.col("clusters")))
    page = positions.select("group_id", "page", (F.col("line") - 1).alias("l"), groups.alias("g")).groupBy("group_id", "page").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("l", "g")))).alias("m"))
    return page.groupBy("group_id").agg(F.map_from_entries(F.collect_list(F.struct("page", "m"))).alias("cluster_groups"))


def snapshots(documents: DataFrame, positions: DataFrame, snapshot_id: Column, created_at: Column) -> DataFrame:
    """One snapshot row per document; id and time are given by the caller. A document is one row by its nature here."""
    lines = snapshot_lines(positions).groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("page", "line", "text"))).alias("lines"))
    rows = documents.join(lines, "group_id").join(cluster_groups(positions), "group_id")
    return rows.select(
        snapshot_id.alias("snapshot_id"), "document_id", created_at.alias("created_at"), "lines", content_hash(F.col("document_id"), F.col("iterations"), F.col("lines")).alias("content_hash"),
        scoring.confidence(F.col("convergence_bps")).alias("confidence"), "iterations", F.struct("source", "cluster_groups").alias("rehydration"), F.lit(SCHEMA_VERSION).alias("schema_version"),
    )


def rehydration_error(confidence: Column, lines: Column, profile: Profile = DEFAULT) -> Column:
    """The first check that a snapshot row fails, in this order, or null: schema_version, duplicate_position (where the profile forbids it),
    rehydration_missing, source_empty, document_mismatch, confidence_mismatch, content_hash_mismatch. confidence is the recomputed one, lines those to be
    hashed; a nil hash isn't checked."""
    place = F.transform("lines", lambda x: F.struct(x["page"].alias("page"), x["line"].alias("line")))
    source = F.col("rehydration.source")
    twice = F.size(F.array_distinct(place)) < F.size(place) if not profile.allow_duplicate_positions else F.lit(False)
    hashed = content_hash(F.col("document_id"), F.col("iterations"), lines)
    return (
        F.when(F.coalesce(F.col("schema_version"), F.lit(0)) != SCHEMA_VERSION, "schema_version")
        .when(F.coalesce(twice, F.lit(False)), "duplicate_position")
        .when(F.col("rehydration").isNull(), "rehydration_missing")
        .when(F.coalesce(F.regexp_replace(source, r"\p{IsWhite_Space}", ""), F.lit("")) == "", "source_empty")
        .when(~F.col("document_id").eqNullSafe(uuid5(NAMESPACE_URL, source)), "document_mismatch")
        .when(F.coalesce(F.abs(confidence - F.col("confidence")) > TOLERANCE, F.lit(True)), "confidence_mismatch")
        .when((F.col("content_hash") != NIL_UUID) & (F.col("content_hash") != hashed), "content_hash_mismatch")
    )


def plurality_confidence(groups: Column) -> Column:
    """The confidence that the incremental reducer gives a map of cluster groups: mean share of the largest cluster, floored in basis points."""
    per_line = F.flatten(F.transform(F.map_values(groups), F.map_values))
    sizes = F.transform(per_line, lambda cs: F.transform(cs, F.size))
    live = F.filter(sizes, lambda s: F.aggregate(s, F.lit(0), lambda a, x: a + x) > 0)
    share = F.transform(live, lambda s: F.floor(F.array_max(s) * F.lit(10_000) / F.aggregate(s, F.lit(0), lambda a, x: a + x)))
    total = F.aggregate(share, F.lit(0).cast("long"), lambda a, x: a + x)
    return (F.when(F.size(share) > 0, F.floor(total / F.size(share))).otherwise(0) / 10_000).cast("float")


def _best(members: Column) -> Column:
    """The longest by bytes, then the smallest."""
    return F.array_min(F.transform(members, lambda m: F.struct((-F.octet_length(m)).alias("a"), m.alias("t"))))["t"]


def rebuilt_lines(groups: Column) -> Column:
    """The lines that a map of cluster groups stands for: winners by the ordinals of their page and line."""
    rank = lambda c: F.struct((-F.size(c)).alias("a"), (-F.octet_length(_best(c))).alias("b"), _best(c).alias("t"))
    winner = lambda cs: F.coalesce(F.array_min(F.transform(F.filter(cs, lambda c: F.size(c) > 0), rank))["t"], F.lit(""))
    line = lambda of, i: lambda key, j: F.struct((i + 1).alias("page"), (j + 1).alias("line"), winner(F.element_at(of, key)).alias("text"))
    page = lambda key, i: F.transform(F.array_sort(F.map_keys(F.element_at(groups, key))), line(F.element_at(groups, key), i))
    return F.flatten(F.transform(F.array_sort(F.map_keys(groups)), page))


def rehydrate(rows: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """Adds error. The hash of a legacy row without lines is taken over the lines that its cluster groups stand for."""
    lines = F.when(F.size("lines") > 0, F.col("lines")).otherwise(rebuilt_lines(F.col("rehydration.cluster_groups")))
    return rows.withColumn("error", rehydration_error(plurality_confidence(F.col("rehydration.cluster_groups")), lines, profile))


def resume(rows: DataFrame, profile: Profile = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(positions, heads) of the snapshots that pass all checks, for a replay to go on from: positions (group_id, page, line_index, groups) and heads
    (group_id, source, iterations), group_id being the document. A row that fails a check gives nothing; rehydrate names the check."""
    good = rehydrate(rows, profile).where("error is null").select(F.col("document_id").alias("group_id"), "iterations", "rehydration")
    counted = lambda c: F.transform(F.array_sort(F.array_distinct(c)), lambda m: F.struct(m.alias("text"), F.size(F.filter(c, lambda x: x == m)).alias("count")))
    pages = good.select("group_id", F.explode("rehydration.cluster_groups").alias("page", "m"))
    positions = pages.select("group_id", "page", F.explode("m").alias("line_index", "g")).select("group_id", "page", "line_index", F.transform("g", counted).alias("groups"))
    return positions, good.select("group_id", F.col("rehydration.source").alias("source"), "iterations")


def observations(documents: DataFrame, observation_id: Column, created_at: Column) -> DataFrame:
    """What is to be said of each document that has not converged. Severity belongs to the reader's policy and stays null."""
    open_ = documents.where("status <> 'Converged'")
    ambiguous = F.col("status") == "Ambiguous"
    note = F.when(ambiguous, F.format_string("ambiguity_score_bps=%d convergence_score_bps=%d", "ambiguity_bps", "convergence_bps")).otherwise(F.format_string("pages=%d iterations=%d", "n_pages", "iterations"))
    return open_.select(
        observation_id.alias("id"), uuid5(NAMESPACE_URL, F.col("source")).alias("document_id"), F.lit(None).cast("int").alias("page"), F.lit("reducer.document").alias("field"), F.col("source").alias("value"),
        scoring.confidence(F.col("convergence_bps")).alias("confidence"), "iterations", "status", F.lit(None).cast("string").alias("severity"),
        F.when(ambiguous, "ambiguity_high").otherwise("reducer_failed").alias("reason_code"), note.alias("note"), created_at.alias("created_at"),
    )
