"""Replay of line events, from the beginning or from a checkpoint.

An event's text is a vote of the incremental reducer at its page and line. A
document's events are taken up by time and id; position by position, as in plurality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenfold.functions.ids import NAMESPACE_OID, uuid5
from evenfold.operators import plurality, snapshots
from evenfold.schema import DEFAULT, Profile
from evenfold.session import cut
from evenfold.sources import store

_SOURCE = "struct<OcrVariant: struct<variant: string, page: int, line_index: int>>"
_PAYLOAD = "struct<OcrLine: struct<text: string, confidence: float>>"


def events_of(lines: DataFrame, timestamp: Column) -> DataFrame:
    """Lines (group_id, variant, page, line, text, confidence) as events with document_id. The id is made from the document, place, text and time,
    so the same line gives the same event; the event's confidence is the line's, or 0."""
    source = F.to_json(F.struct(F.struct("variant", "page", (F.col("line") - 1).alias("line_index")).alias("OcrVariant")))
    payload = F.to_json(F.struct(F.struct("text", "confidence").alias("OcrLine")))
    named = F.concat_ws("#", "group_id", "variant", F.col("page").cast("string"), F.col("line").cast("string"), "text", timestamp.cast("string"))
    return lines.select(
        uuid5(NAMESPACE_OID, named).alias("id"), F.lit(1).alias("schema_version"), timestamp.alias("timestamp"), source.alias("source"), payload.alias("payload"),
        F.coalesce(F.col("confidence").cast("float"), F.lit(0.0).cast("float")).alias("confidence"), F.col("group_id").alias("document_id"),
    )


def observation_events(observations: DataFrame, timestamp: Column) -> DataFrame:
    """Observations as events of the reducer, which replay skips."""
    payload = F.to_json(F.struct(F.struct(*observations.columns).alias("Observation")))
    return observations.select(
        uuid5(NAMESPACE_OID, F.concat_ws("#", F.lit("observation"), "id")).alias("id"), F.lit(1).alias("schema_version"), timestamp.alias("timestamp"), F.lit('"Reducer"').alias("source"), payload.alias("payload"),
        F.coalesce(F.col("confidence").cast("float"), F.lit(0.0).cast("float")).alias("confidence"), "document_id",
    )


def lines_of(events: DataFrame, key: str) -> DataFrame:
    """(group_id, id, timestamp, page, line_index, text, variant, applied): applied is false for events of another source or payload (and for JSON that doesn't parse),
    which replay skips. page and line_index default to 0."""
    s, p = F.from_json("source", _SOURCE), F.from_json("payload", _PAYLOAD)
    named = events.select(F.col(key).alias("_key"), "id", "timestamp", "source", "payload")
    rows = plurality.once(named, F.col("_key").alias("group_id"), s.alias("s"), p.alias("p")).where("group_id is not null")
    at = F.col("s.OcrVariant")
    return rows.select(
        "group_id", "id", "timestamp", F.coalesce(at["page"], F.lit(0)).alias("page"), F.coalesce(at["line_index"], F.lit(0)).alias("line_index"),
        F.coalesce(F.col("p.OcrLine.text"), F.lit("")).alias("text"), at["variant"].alias("variant"), (at.isNotNull() & F.col("p.OcrLine").isNotNull()).alias("applied"),
    )


def counters(lines: DataFrame, *by: str) -> DataFrame:
    """(group_id, or what by says, applied_events, skipped_events, source): source is that of the first applied event."""
    first = F.min(F.when(F.col("applied"), F.struct("timestamp", "id")))["id"]
    return lines.groupBy(*(by or ("group_id",))).agg(F.count_if("applied").alias("applied_events"), F.count_if(~F.col("applied")).alias("skipped_events"), F.concat(F.lit("event://"), first).alias("source"))


def replay(events: DataFrame, key: str, checkpoint: DataFrame | None = None, heads: DataFrame | None = None, kept: bool = False) -> tuple[DataFrame, DataFrame]:
    """(positions, documents). checkpoint: positions (group_id, page, line_index, groups) to go on from, and heads: its documents
    (group_id, source, iterations). A document keeps its checkpoint's source, and its iterations go on from there; without one, its first applied
    event is its source. Documents of the checkpoint without later events are there as well. kept: both are wanted, so
    the replay is made and written once."""
    lines = lines_of(events, key)
    if kept:
        folded = cut(plurality.fold_events(lines, checkpoint))
        return folded.where("total is not null").select("group_id", "page", "line_index", "winner", "largest", "total", "groups"), _documents(folded, heads)
    folded = plurality.fold(lines.where("applied"), [F.col("timestamp"), F.col("id")], checkpoint).drop("at_cut")
    return folded, _documents(plurality.fold_events(lines, checkpoint, groups=False), heads)


def _documents(folded: DataFrame, heads: DataFrame | None) -> DataFrame:
    """Documents of fold_events. Those without events are left to the heads."""
    counts = [F.sum(c).alias(c) for c in ("applied_events", "skipped_events")]
    found = folded.groupBy("group_id").agg(*counts, _source().alias("source"), plurality.convergence().alias("convergence_bps"))
    any_ = F.col("applied_events") + F.col("skipped_events") > 0
    if heads is None:
        found = found.where(any_).withColumn("iterations", F.col("applied_events"))
    else:
        old = heads.select("group_id", F.col("source").alias("_s"), F.col("iterations").cast("long").alias("_i"), F.lit(True).alias("_old"))
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
        found = found.join(old, "group_id", "full").where(any_ | F.col("_old"))
        found = found.select("group_id", zero("applied_events").alias("applied_events"), zero("skipped_events").alias("skipped_events"), F.coalesce("_s", "source").alias("source"), (zero("_i") + zero("applied_events")).alias("iterations"), "convergence_bps")
    bps = F.coalesce("convergence_bps", F.lit(0))
    return found.select("group_id", "applied_events", "skipped_events", "source", "iterations", bps.alias("convergence_bps"), (F.lit(10_000) - bps).alias("ambiguity_bps"))


def _source(among: Column | None = None) -> Column:
    """An aggregate over positions of fold_events: the source that the first applied event gives."""
    here = F.col("applied_events") > 0 if among is None else among
    return F.concat(F.lit("event://"), F.min(F.when(here, F.struct("first_timestamp", "first_id")))["first_id"])


def after(events: DataFrame, heads: DataFrame) -> DataFrame:
    """Events later than the whole second of their document's snapshot (group_id, created_at); those of documents without one are all kept.
    Both meet by document."""
    last = heads.groupBy("group_id").agg(F.greatest(F.lit(0), F.unix_seconds(F.max("created_at").cast("timestamp"))).alias("_cut"))
    return events.join(last, "group_id", "left").where("_cut is null or timestamp > _cut").drop("_cut")


def from_latest(events: DataFrame, stored: DataFrame | None, document: str | None = None, profile: Profile = DEFAULT) -> DataFrame:
    """Documents (as of replay(), with mode) of events by document_id: each goes on from its latest stored snapshot with the events after it, or starts from the
    beginning where it has none. A latest snapshot that fails a check is an error, as going on without it would hide the damage."""
    if stored is None:
        return replay(events, "document_id")[1].withColumn("mode", F.lit("genesis"))
    mine = stored.where(F.col("document_id") == document) if document else stored
    last = cut(snapshots.rehydrate(store.latest(mine, "document_id", ["created_at", "snapshot_id"]), profile))
    bad = last.where("error is not null").select("document_id", "error").first()
    if bad is not None:
        raise ValueError(f"the snapshot of {bad.document_id} can't be resumed: {bad.error}")
    positions, heads = snapshots.resume(last.drop("error"), profile)
    tail = after(events.withColumn("group_id", F.col("document_id")), last.select(F.col("document_id").alias("group_id"), "created_at"))
    documents = replay(tail, "document_id", positions, heads)[1]
    known = heads.select("group_id", F.lit("checkpoint+tail").alias("mode"))
    return documents.join(known, "group_id", "left").withColumn("mode", F.coalesce("mode", F.lit("genesis")))


def equivalent(events: DataFrame, key: str, cut_at: int) -> DataFrame:
    """(group_id, source, iterations, convergence_bps, ambiguity_bps, equivalent): whether a replay up to time cut_at and one of the rest from there gives
    what one replay gives: the same source, iterations and scores, and the same clusters at every position. Every document with events is there. Both
    replays are made in one pass: each event is taken up once before the cut and twice after it. A cut later than the last event is an error."""
    last = events.where(F.col(key).isNotNull()).agg(F.max("timestamp")).first()[0]
    if last is not None and cut_at > last:
        raise ValueError(f"the cut {cut_at} lies beyond the last event at {last}")
    folded = plurality.fold_events(lines_of(events, key), late=F.coalesce(F.col("timestamp") > cut_at, F.lit(False)), groups=False)
    score = lambda largest, total: F.coalesce(plurality.convergence(largest, total), F.lit(0))
    # the resumed replay keeps the source of its checkpoint, and its iterations go on from there
    own = F.struct(_source().alias("source"), F.sum("applied_events").alias("iterations"), score("largest", "total").alias("convergence_bps"))
    resumed = F.struct(F.coalesce(_source(F.col("early_events") > 0), _source()).alias("source"), (F.sum("early_events") + F.sum("late_events")).alias("iterations"), score("resumed_largest", "resumed_total").alias("convergence_bps"))
    got = folded.groupBy("group_id").agg(own.alias("x"), resumed.alias("y"), F.every("same").alias("clusters"))
    return got.select("group_id", "x.*", (F.lit(10_000) - F.col("x.convergence_bps")).alias("ambiguity_bps"), (F.col("x").eqNullSafe(F.col("y")) & F.col("clusters")).alias("equivalent"))
