"""Queries of the reducer and its surroundings over ocr_lines, ocr_events, raw_observations and the snapshot tables, with their SQL."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenfold.functions import scoring, similarity, text
from evenfold.functions.ids import NAMESPACE_OID, NAMESPACE_URL, plain_uuid, uuid5
from evenfold.operators import image, messages, plurality, replay, roi, snapshots, weighted
from evenfold.plans import folds, pipeline
from evenfold.schema import PROFILES
from evenfold.session import checkpoint_dir, cut, table
from evenfold.sources import store
from evenfold.sources import text as texts

def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ocr_lines")


def _distinct(spark: SparkSession, d: str) -> DataFrame:
    """The lines with every reading as a source of its own."""
    return _lines(spark, d).withColumn("source", F.concat(F.coalesce("source", F.lit("")), F.lit("#"), F.coalesce("variant", F.lit(""))))


def lines_scan(spark: SparkSession, d: str) -> DataFrame:
    return texts.to_lines(table(spark, d, "documents"), ["doc_id"])


def lines_keep_blank(spark: SparkSession, d: str) -> DataFrame:
    return texts.to_lines_keep_blank(table(spark, d, "documents"), ["doc_id"])


def document_text(spark: SparkSession, d: str) -> DataFrame:
    return texts.to_text(_lines(spark, d), ["group_id", "variant"])


def normalize_canonical(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("line_id", text.canonical(F.col("text")).alias("text")).where("text <> ''")


def _normalize(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return texts.normalize(_lines(spark, d), PROFILES[name]).select("line_id", "page", "line", "text")

    return query


def vote_keys(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return _lines(spark, d).select("line_id", text.vote_variant(c).alias("variant_text"), text.vote_key(c).alias("vote_key"), scoring.weight(F.col("confidence")).alias("weight"))


def incremental_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("line_id", text.plain(F.col("text")).alias("plain"))


def single_votes(spark: SparkSession, d: str) -> DataFrame:
    return weighted.single_votes(weighted.votes(_lines(spark, d)))


def _exact(shared: bool):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return weighted.reduce_documents(_lines(spark, d), 1.0, "shared" if shared else "distinct")[0]

    return query


def positions_exact(spark: SparkSession, d: str) -> DataFrame:
    got = weighted.positions(_distinct(spark, d), 1.0)
    return got.select("group_id", "page", "line", "winner", "convergence_bps", "ambiguity_bps", "votes", "collisions", F.size("clusters").alias("n_clusters"))


def reduce_documents(spark: SparkSession, d: str) -> DataFrame:
    """Status, convergence and the winners' text of every document."""
    documents, positions = weighted.reduce_documents(_lines(spark, d))
    winners = texts.to_text(positions.select("group_id", "page", "line", F.col("winner").alias("text")), ["group_id"]).withColumnRenamed("text", "winner_text")
    return documents.join(winners, "group_id")


def reduce_strict(spark: SparkSession, d: str) -> DataFrame:
    return weighted.reduce_documents(_lines(spark, d), PROFILES["strict"].similarity_threshold)[0]


def positions_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Clusters and scores of every position, the clusters as one string of texts with their votes."""
    members = F.array_join(F.transform("clusters", lambda c: F.concat(c["text"], F.lit("#"), c["count"].cast("string"))), " ; ")
    return weighted.positions(_lines(spark, d)).withColumn("clusters", members)


def _runners(spark: SparkSession, d: str) -> DataFrame:
    return weighted.positions(_distinct(spark, d))


def alternatives(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate of every position with its rank."""
    got = _runners(spark, d).select("group_id", "page", "line", F.posexplode("clusters").alias("rank", "c"))
    return got.select("group_id", "page", "line", (F.col("rank") + 1).alias("rank"), "c.text", F.col("c.total_weight").cast("double").alias("total_weight"), F.col("c.count").alias("n"))


def winner_runner_up(spark: SparkSession, d: str) -> DataFrame:
    c = lambda i, f: F.get("clusters", F.lit(i))[f]
    got = _runners(spark, d).where(F.size("clusters") > 1)
    return got.select("group_id", "page", "line", c(0, "text").alias("winner"), c(1, "text").alias("runner_up"), (c(0, "total_weight") - c(1, "total_weight")).cast("float").cast("double").alias("lead"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Different keys of all readings at one position, each unordered pair once, the smaller key first."""
    keyed = _lines(spark, d).where("text is not null").select("group_id", "page", "line", text.vote_key(F.col("text")).alias("k")).where("k <> ''").distinct()
    return keyed.withColumnRenamed("k", "a").join(keyed.withColumnRenamed("k", "b"), ["group_id", "page", "line"]).where("a < b").select("a", "b").distinct()


def jw_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The similarity of all pairs, in every script."""
    return _pairs(spark, d).select("a", "b", F.round(similarity.jw("a", "b"), 6).alias("similarity"))


def semantic_veto_pairs(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    same = text.has_cyrillic(a) == text.has_cyrillic(b)
    return _pairs(spark, d).select("a", "b", text.veto(a, b).alias("veto"), same.alias("same_script"), text.differs_in_numbers(a, b).alias("differs_in_numbers"))


def key_traits(spark: SparkSession, d: str) -> DataFrame:
    """Numbers, negation and script of every vote key."""
    k = text.vote_key(F.col("text"))
    return _lines(spark, d).where("text is not null").select("line_id", k.alias("k")).select(
        "line_id", F.array_join(text.numeric_tokens(F.col("k")), " ").alias("numbers"), text.negated(F.col("k")).alias("negated"), text.has_cyrillic(F.col("k")).alias("cyrillic"))


def fields_projection(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.fields(_runners(spark, d))


def snapshot_lines(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_lines(_runners(spark, d))


def cluster_groups(spark: SparkSession, d: str) -> DataFrame:
    got = snapshots.cluster_groups(_runners(spark, d))
    return got.select("group_id", F.explode("cluster_groups").alias("page", "m")).select("group_id", "page", F.explode("m").alias("line_index", "g")).select(
        "group_id", "page", "line_index", F.array_join(F.flatten("g"), "|").alias("members"))


def snapshot_documents(spark: SparkSession, d: str) -> DataFrame:
    documents, positions = weighted.reduce_documents(_lines(spark, d))
    made = snapshots.snapshots(documents, positions, uuid5(NAMESPACE_URL, F.col("group_id")), F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"))
    return made.select("snapshot_id", "document_id", "content_hash", "confidence", "iterations", F.size("lines").alias("n_lines"))


def rehydrate_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Whether each snapshot could be resumed: those of the weighted reducer may differ in confidence from what counting gives."""
    documents, positions = weighted.reduce_documents(_lines(spark, d))
    made = snapshots.snapshots(documents, positions, uuid5(NAMESPACE_URL, F.col("group_id")), F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"))
    good = made.withColumn("confidence", snapshots.plurality_confidence(F.col("rehydration.cluster_groups")))
    both = snapshots.rehydrate(made).select("document_id", F.col("error").alias("as_written")).join(snapshots.rehydrate(good).select("document_id", F.col("error").alias("recounted")), "document_id")
    return both


def observations(spark: SparkSession, d: str) -> DataFrame:
    documents, _ = weighted.reduce_documents(_lines(spark, d))
    made = snapshots.observations(documents, uuid5(NAMESPACE_URL, F.col("group_id")), F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"))
    checked = made.withColumn("invalid", scoring.invalid(F.col("status"), F.col("confidence"), F.col("severity"), F.col("reason_code")))
    return checked.select("id", "document_id", "field", "value", "confidence", "iterations", "status", "reason_code", "note", "invalid")


def document_uuid(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).where("source is not null").select("source", uuid5(NAMESPACE_URL, F.col("source")).alias("document_id")).distinct()


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    """Content hash of every snapshot of snapshot_metadata's and document_snapshots' lines."""
    lines = table(spark, d, "snapshot_lines").groupBy("snapshot_id").agg(F.collect_list(F.struct("page", "line", "text")).alias("lines"))  # of one snapshot
    return lines.select("snapshot_id", snapshots.content_hash(F.col("snapshot_id"), F.size("lines"), F.col("lines")).alias("content_hash"))


def roi_atomic(spark: SparkSession, d: str) -> DataFrame:
    return roi.numeric_alternatives(_runners(spark, d))


def roi_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Numeric conflicts within the clusters of the incremental reducer."""
    return roi.numeric_conflicts(_plurality(spark, d))


def _mixed_rois(spark: SparkSession, d: str) -> DataFrame:
    """Positions with every reason to read them again, found in one pass."""
    got = _runners(spark, d).where("size(clusters) > 1 or ambiguity_bps >= 4000")
    when = lambda condition, reason: F.when(condition, F.lit(reason))
    reasons = F.array(when(roi.differs_by_numbers(F.col("clusters")), "NumericConflict"), when(F.size("clusters") > 2, "DenseCluster"), when(F.col("ambiguity_bps") >= 4000, "Ambiguity"))
    return got.select("group_id", "page", "line", F.explode(F.array_compact(reasons)).alias("reason"))


def roi_merged(spark: SparkSession, d: str) -> DataFrame:
    return roi.merge(_mixed_rois(spark, d), 2)


def roi_plan(spark: SparkSession, d: str) -> DataFrame:
    got = roi.plan(_mixed_rois(spark, d), 2)
    return got.select("group_id", "atomic_count", "plan_hash", F.size("regions").alias("n_regions"), F.aggregate("regions", F.lit(0), lambda a, r: a + r["line_end"] - r["line_start"] + 1).alias("n_lines"))


def roi_refine(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d).where("text is not null").groupBy("group_id", "variant", "page", "line").agg(F.min("text").alias("text"))
    return roi.refine(roi.merge(_mixed_rois(spark, d), 2), lines)


def _plurality(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d).select("group_id", "page", (F.col("line") - 1).alias("line_index"), "text", "variant", "line_id")
    return plurality.fold(lines, [F.col("variant"), F.col("line_id")])


def _members(folded: DataFrame) -> DataFrame:
    """Positions with their clusters as one string."""
    return folded.drop("at_cut").withColumn("groups", F.array_join(F.transform(plurality.spelled(F.col("groups")), lambda g: F.array_join(g, "|")), " ; "))


def plurality_positions(spark: SparkSession, d: str) -> DataFrame:
    return _members(_plurality(spark, d))


def plurality_metrics(spark: SparkSession, d: str) -> DataFrame:
    return plurality.metrics(_plurality(spark, d))


def plurality_pages(spark: SparkSession, d: str) -> DataFrame:
    return plurality.pages(_plurality(spark, d))


def latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    heads = table(spark, d, "snapshot_metadata").withColumn("document_id", plain_uuid("document_id"))
    return store.latest(heads.where("document_id is not null"), "document_id", ["created_at", "arrived_at", "snapshot_id"]).select("document_id", "snapshot_id", "created_at")


def events_after_snapshot(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "ocr_events").withColumn("group_id", plain_uuid("document_id"))
    heads = table(spark, d, "snapshot_metadata").select(plain_uuid("document_id").alias("group_id"), "created_at").where("group_id is not null")
    return replay.after(events.where("group_id is not null"), heads).groupBy("group_id").agg(F.count(F.lit(1)).alias("n_events"), F.min("timestamp").alias("first"))


def replace_into(spark: SparkSession, d: str) -> DataFrame:
    """Snapshot heads stored export by export: the last one stays."""
    rows = table(spark, d, "document_snapshots").select("snapshot_id", "export_no", "iterations")
    return store.replace_into(rows.where("export_no = 1").dropDuplicates(["snapshot_id"]), rows.where("export_no > 1"), ["snapshot_id"], ["export_no", "iterations"]).select("snapshot_id", "export_no")


def ignore_into(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "document_snapshots").select("snapshot_id", "export_no", "iterations")
    return store.ignore_into(rows.where("export_no = 1").dropDuplicates(["snapshot_id"]), rows.where("export_no > 1"), ["snapshot_id"], ["export_no", "iterations"]).select("snapshot_id", "export_no")


def snapshot_with_lines(spark: SparkSession, d: str) -> DataFrame:
    heads = table(spark, d, "document_snapshots").select("snapshot_id").distinct()
    got = store.with_lines(heads, table(spark, d, "snapshot_lines"))
    return got.select("snapshot_id", F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"), F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("text"))


def duplicate_positions(spark: SparkSession, d: str) -> DataFrame:
    return store.duplicate_positions(table(spark, d, "snapshot_lines"), ["snapshot_id"])


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ocr_events").withColumn("group_id", plain_uuid("document_id"))


def event_lines(spark: SparkSession, d: str) -> DataFrame:
    """Events as lines: what replay applies and what it skips."""
    return replay.lines_of(_events(spark, d), "group_id").drop("variant")


def events_from_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines written as events and read again."""
    lines = _lines(spark, d).where("text is not null")
    made = replay.events_of(lines, F.lit(1771113600).cast("long") + F.col("line_id"))
    return replay.lines_of(made, "document_id").select("group_id", "id", "page", "line_index", "text", "variant", "applied")


def replay_genesis(spark: SparkSession, d: str) -> DataFrame:
    return replay.replay(_events(spark, d), "group_id")[1]


def replay_positions(spark: SparkSession, d: str) -> DataFrame:
    return _members(replay.replay(_events(spark, d), "group_id")[0])


#: 2026-02-15 00:00 UTC
CUT = 1771113600


def replay_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    events = _events(spark, d)
    head, _ = replay.replay(events.where(F.col("timestamp") <= CUT), "group_id")
    return _members(replay.replay(events.where(F.col("timestamp") > CUT), "group_id", head.select("group_id", "page", "line_index", "groups"))[0])


def replay_equivalence(spark: SparkSession, d: str) -> DataFrame:
    return replay.equivalent(_events(spark, d), "group_id", CUT)


def otsu_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Otsu's threshold of the lineitem quantities of each flag, taken as gray levels."""
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("image_id"), (F.col("l_quantity").cast("int") * 5 + F.when(F.col("l_linestatus") == "O", 3).otherwise(0)).alias("level"))
    return image.otsu_table(rows.groupBy("image_id", "level").agg(F.count(F.lit(1)).alias("n")))


def _images(spark: SparkSession, d: str) -> DataFrame:
    """Every embedding drawn as a gray image, eight pixels wide."""
    e = table(spark, d, "embeddings").where("embedding is not null")
    px = F.transform("embedding", lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x.cast("double") * 64 + 128).cast("int")))), 2, "0"))
    return e.select(F.col("vec_id").cast("string").alias("image_id"), F.lit(8).alias("width"), F.floor(F.size("embedding") / 8).cast("int").alias("height"), F.unhex(F.array_join(px, "")).alias("pixels"))


def _white(when: Column) -> Column:
    """How many pixels of a row are 255; -1 where that isn't asked."""
    h = F.hex("pixels")
    return F.when(when, F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(h) - 1, F.lit(1)), F.lit(2)), F.lit(0), lambda n, i: n + (F.substring(h, i, F.lit(2)) == "FF").cast("int"))).otherwise(-1)


def image_variants(spark: SparkSession, d: str) -> DataFrame:
    """Small images in every variant; of the binary one also how much is white."""
    return image.variants(_images(spark, d)).withColumns({"n_white": _white(F.col("variant") == "high_contrast"), "threshold": F.coalesce("threshold", F.lit(-1))}).drop("pixels")


def image_regions(spark: SparkSession, d: str) -> DataFrame:
    """Two crops of each image, binarized, one of them enlarged and one beyond the image's edge."""
    roi_ = lambda kind, x, y, w, h, to: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(w).alias("width"), F.lit(h).alias("height"), F.lit(kind).alias("kind"), to.alias("resize"))
    none = F.lit(None).cast("struct<w: int, h: int>")
    rois = F.array(roi_("title_block", 1, 2, 5, 4, none), roi_("signature", 5, 6, 9, 9, none), roi_("invoice_totals", 0, 0, 5, 4, F.struct(F.lit(10).alias("w"), F.lit(8).alias("h"))))
    got = image.regions(_images(spark, d).select("*", F.explode(rois).alias("roi")))
    return got.withColumn("n_white", _white(F.col("resize_factor").isNull())).drop("pixels")


def _count_white(content: bytes, lang: str, variant: str) -> str:
    """A provider that reads a gray PNG's size and counts its white pixels."""
    at, data, width, height = 8, b"", 0, 0
    while at < len(content):
        n, kind = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
        if kind == b"IHDR":
            width, height = int.from_bytes(content[at + 8 : at + 12], "big"), int.from_bytes(content[at + 12 : at + 16], "big")
        elif kind == b"IDAT":
            data += content[at + 8 : at + 8 + n]
        at += 12 + n
    rows = zlib.decompress(data)
    return f"size {width} {height}\nwhite {sum(rows[k * (width + 1) + 1 : (k + 1) * (width + 1)].count(255) for k in range(height))}"


def image_readings(spark: SparkSession, d: str) -> DataFrame:
    """Images to variants to PNG to a provider's texts to lines."""
    readings = pipeline.read_documents(_images(spark, d), "ita", _count_white, ("original", "high_contrast"))
    return texts.to_lines(readings, ["source", "variant"])


def jsonl_events(spark: SparkSession, d: str) -> DataFrame:
    """Events appended to JSON lines in two goes and read again."""
    path = f"{checkpoint_dir(spark)}/events-{uuid.uuid4().hex}"
    events = table(spark, d, "ocr_events").select("id", "schema_version", "timestamp", "source", "payload", "document_id")
    late = F.coalesce(F.col("timestamp") > CUT, F.lit(False))
    for part in (events.where(~late), events.where(late)):
        store.append_jsonl(part, path)
    return store.read_jsonl(spark, path, "id string, schema_version int, timestamp bigint, source string, payload string, document_id string").withColumn("schema_version", F.coalesce("schema_version", F.lit(-1)))


def _pipeline(spark: SparkSession, d: str) -> pipeline.Result:
    """The whole plan over the texts of raw_observations. Of repeated deliveries the first with a text counts; second scans vote as readings of their own."""
    delivered = table(spark, d, "raw_observations").where("raw_text is not null")
    # what else differs between rows delivered together settles the tie before the id's spelling could
    kept = messages.accept(delivered, "observation_id", ["batch_no", "arrived_at", "raw_text", "source", "variant"])
    reading = F.coalesce(plain_uuid("observation_id"), F.sha2(F.to_json(F.struct("batch_no", "arrived_at", "raw_text")), 256))
    return pipeline.process(kept.select("source", "variant", reading.alias("reading"), F.col("raw_text").alias("text")), F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"))


def stored_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The pipeline's raw readings as its store has them, with the id of their document's latest snapshot there."""
    root = f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    pipeline.persist(_pipeline(spark, d), root)
    last = store.latest(spark.read.parquet(f"{root}/snapshots"), "document_id", ["created_at", "snapshot_id"]).select("document_id", "snapshot_id")
    raw = spark.read.parquet(f"{root}/raw_observations").select("observation_id", "document_id", "source", "variant", "raw_text", "normalized_text", "profile_used.kind")
    return raw.join(last, "document_id", "left")


def replay_latest(spark: SparkSession, d: str) -> DataFrame:
    """Events up to CUT replayed and stored as snapshots, then each document resumed from its snapshot. A document's id is here that of its first event."""
    events = _events(spark, d)
    named = cut(replay.counters(replay.lines_of(events, "group_id")).select("group_id", uuid5(NAMESPACE_URL, F.col("source")).alias("doc")).where("doc is not null"))
    events = events.join(named, "group_id").select("id", "timestamp", "source", "payload", F.col("doc").alias("document_id"))
    positions, documents = replay.replay(events.where(F.col("timestamp") <= CUT), "document_id", kept=True)
    documents = documents.withColumns({"document_id": F.col("group_id"), "iterations": F.col("iterations").cast("int")})
    state = positions.withColumns({"line": F.col("line_index") + 1, "convergence_bps": F.lit(None).cast("int")})
    stored = cut(snapshots.snapshots(documents, state, F.col("group_id"), F.timestamp_seconds(F.lit(CUT))))
    return replay.from_latest(events, stored)


def pipeline_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The whole plan to snapshots."""
    return _pipeline(spark, d).snapshots.select("snapshot_id", "document_id", "content_hash", "confidence", "iterations", F.size("lines").alias("n_lines"))


QUERIES = {f.__name__: f for f in (
    reduce_documents, reduce_strict, positions_fuzzy, positions_exact, lines_scan, lines_keep_blank, document_text, normalize_canonical, vote_keys, incremental_normalize, single_votes,
    alternatives, winner_runner_up, jw_pairs, semantic_veto_pairs, key_traits, fields_projection, snapshot_lines, cluster_groups, snapshot_documents, rehydrate_snapshots, observations,
    document_uuid, content_hash, roi_atomic, roi_clusters, roi_merged, roi_plan, roi_refine, plurality_positions, plurality_metrics, plurality_pages, latest_snapshot, events_after_snapshot,
    replace_into, ignore_into, snapshot_with_lines, duplicate_positions, event_lines, events_from_lines, replay_genesis, replay_positions, replay_checkpoint, replay_equivalence, replay_latest, jsonl_events, otsu_threshold, image_variants, image_regions, image_readings,
    pipeline_snapshots, stored_pipeline,
)}
QUERIES |= {f"normalize_{name}": _normalize(name) for name in PROFILES}
QUERIES |= {"reduce_exact": _exact(False), "reduce_exact_shared": _exact(True)}

# SQL. RE2 has no look-around, so a comma between digits is replaced twice: each pass takes every other one.
_WS = r"[\t\n\x0B\x0C\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_trim = lambda t: rf"regexp_replace({t}, '^{_WS}+|{_WS}+$', '', 'g')"


def _comma(t: str) -> str:
    for _ in range(2):
        t = rf"regexp_replace({t}, '([0-9]),([0-9])', '\1.\2', 'g')"
    return t


_CANON = _comma(_trim("nfc_normalize(text)"))
_BARE = r"regexp_replace(nfc_normalize(text), '[\x{00AD}\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]', '', 'g')"
_VARIANT = _comma(rf"regexp_replace({_trim(_BARE)}, '{_WS}+', ' ', 'g')")
_WEIGHT = "cast(case when confidence is null then 1 when isnan(confidence) or isinf(confidence) then 0 else greatest(0, least(1, confidence)) end as float)"
_UUID = r"""regexp_replace(lower({c}), '(^\s*\{{?\s*(urn:uuid:)?)|(\}}?\s*$)|-', '', 'g')"""


def _plain(c: str) -> str:
    h = _UUID.format(c=c)
    return f"(case when regexp_matches({h}, '^[0-9a-f]{{32}}$') then regexp_replace({h}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') else trim({c}) end)"


def _uuid5(ns: str, s: str) -> str:
    h = f"sha1(from_hex('{ns}') || encode({s}))"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', cast(instr('0123456789abcdef', substr({h}, 17, 1)) - 1 as int) % 4 + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"


def _normal(name: str) -> str:
    p = PROFILES[name]
    keep = f"confidence is null or cast(confidence as double) >= {p.min_confidence}" if p.min_confidence else "true"
    collapsed = _trim(rf"regexp_replace({_CANON}, '[ \t\n\f\r]+', ' ', 'g')")
    return f"""
        with n as (select line_id, group_id, variant, page, line, {collapsed} as text from ocr_lines where text is not null and ({keep}))
        select line_id, page, cast(row_number() over (partition by group_id, variant, page order by line, line_id) as int) as line, text from n where text <> ''"""


def _votes(distinct: bool) -> str:
    """One vote per position, key and source of the lines as they are."""
    source = "coalesce(source, '') || '#' || coalesce(variant, '')" if distinct else "coalesce(source, '')"
    return f"""select group_id, page, line, k, vt, w from (select group_id, page, line, lower(vt) as k, vt, w, row_number() over (partition by group_id, page, line, lower(vt), src order by vt, w desc) as rn
            from (select group_id, page, line, {_VARIANT} as vt, {_WEIGHT} as w, {source} as src from ocr_lines where text is not null) where vt <> '') where rn = 1"""


def _documents(shared: bool, threshold: float) -> str:
    return f"""{folds.weighted(_votes(not shared), threshold)},
        h as (select group_id, min(src) as source, cast(count(distinct (src, coalesce(variant, ''))) as int) as iterations from (select group_id, variant, {"coalesce(source, '')" if shared else "coalesce(source, '') || '#' || coalesce(variant, '')"} as src from ocr_lines) group by all),
        q as (select group_id, count(*) as n_positions, count(distinct page) as n_pages, cast(sum(votes) as bigint) as total_votes, cast(sum(convergence_bps) // count(*) as int) as convergence_bps, cast(sum(ambiguity_bps) // count(*) as int) as ambiguity_bps,
            cast(sum(collisions) * 10000 // sum(votes) as int) as collision_rate_bps, cast(sum(negation_conflicts) as bigint) as g1, cast(sum(numeric_conflicts) as bigint) as g2 from p group by all),
        d as (select group_id, {_uuid5(NAMESPACE_URL, 'source')} as document_id, source, iterations, n_pages, n_positions, total_votes, convergence_bps, ambiguity_bps, collision_rate_bps,
            g1 as negation_conflicts, g2 as numeric_conflicts, g1 + g2 as semantic_conflict_count,
            case when ambiguity_bps <= 1000 and convergence_bps >= 9000 then 'Converged' when convergence_bps >= 5000 then 'Ambiguous' else 'Failed' end as status from q join h using (group_id))"""


def _bare_words(t: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({t}), '[^\p{{L}}\p{{N}}' || substr('{_WS}', 2, length('{_WS}') - 2) || ']', '', 'g'), '{_WS}+', ' ', 'g'))"


_COUNTED = folds.counted(f"""select group_id, page, line - 1 as line_index, t, row_number() over (partition by group_id, page, line order by variant nulls first, line_id nulls first, t) as i
            from (select *, {_bare_words('text')} as t from ocr_lines where text is not null and group_id is not null and page is not null and line is not null) where t <> ''""")
_EVENTS = f"""
        ev as (select {_plain('document_id')} as group_id, id, timestamp, try_cast(source as json) as s, try_cast(payload as json) as pa from ocr_events where document_id is not null),
        el as (select group_id, id, timestamp, coalesce(try_cast(s->>'$.OcrVariant.page' as int), 0) as page, coalesce(try_cast(s->>'$.OcrVariant.line_index' as int), 0) as line_index, coalesce(pa->>'$.OcrLine.text', '') as text,
            coalesce(json_type(s->'$.OcrVariant') = 'OBJECT', false) and coalesce(json_type(pa->'$.OcrLine') = 'OBJECT', false) as applied from ev)"""
_REPLAYED = _EVENTS + "," + folds.counted(f"""select group_id, page, line_index, t, row_number() over (partition by group_id, page, line_index order by timestamp nulls first, id nulls first, t) as i
            from (select *, {_bare_words('text')} as t from el where applied) where t <> ''""")
#: The default reducer over lines as they are, every reading a source of its own.
_RUN = folds.weighted(_votes(True), 0.9)
_FIELDS = "f as (select group_id, page, cast(row_number() over (partition by group_id, page order by line) as int) as n, cast(dense_rank() over (partition by group_id order by page) as int) as po, winner as text from p)"
_DIFFERS = "regexp_replace(lower({a}), '[0-9]', '', 'g') = regexp_replace(lower({b}), '[0-9]', '', 'g') and string_split_regex(lower({a}), '[^0-9]') <> string_split_regex(lower({b}), '[^0-9]')"
_PAIRS = f"""
        k as (select distinct group_id, page, line, lower({_VARIANT}) as k from ocr_lines where text is not null),
        x as (select distinct a.k as a, b.k as b from k a join k b using (group_id, page, line) where a.k < b.k and a.k <> '')"""
_ROIS = f"""{_RUN},
        e as (select group_id, page, line, t, lead(t) over (partition by group_id, page, line order by rank) as u from r),
        z as (select distinct group_id, page, line, 'NumericConflict' as reason from e where {_DIFFERS.format(a='t', b='u')}),
        y as (select * from z union all select group_id, page, line, 'DenseCluster' from p where n_clusters > 2 union all select group_id, page, line, 'Ambiguity' from p where ambiguity_bps >= 4000),
        o2 as (select *, case reason when 'NumericConflict' then 0 when 'Ambiguity' then 1 else 2 end as o, greatest(0, line - 2) as s, line + 2 as e from y),
        b2 as (select *, max(e) over (partition by group_id, page order by line, o rows between unbounded preceding and 1 preceding) as before from o2),
        g2 as (select *, sum(case when before is null or s > before + 1 then 1 else 0 end) over (partition by group_id, page order by line, o rows unbounded preceding) as g from b2),
        m2 as (select group_id, page, cast(min(s) as int) as line_start, cast(max(e) as int) as line_end, arg_min(reason, (o, line)) as dominant_reason, cast(count(*) as int) as atomic_count,
            case when arg_min(reason, (line, o)) = 'DenseCluster' then 'Original' else 'HighContrast' end as preprocess_hint from g2 group by group_id, page, g)"""
_SNAP = f"""{_documents(False, 0.9)}, {_FIELDS},
        j as (select group_id, list({{'line': n, 'page': po, 'text': text}} order by po, n, text) as lines from f group by all)"""

_SEEN = f"""select source, variant as kind, coalesce(variant, '') || '#' || {_plain('observation_id')} as variant, raw_text from raw_observations where raw_text is not null and source is not null and observation_id is not null
            qualify row_number() over (partition by {_plain('observation_id')} order by batch_no nulls first, arrived_at nulls first, raw_text, source nulls first, variant nulls first) = 1"""
_NORMAL = f"""
        sn as ({_SEEN}),
        sl as (select source as group_id, kind, variant, l[i] as text, i as line from (select *, list_filter(list_transform(string_split_regex(raw_text, '\r?\n'), lambda x: {_trim('x')}), lambda x: x <> '') as l from sn), unnest(range(1, len(l) + 1)) as u(i)),
        nl as (select group_id, kind, variant, 1 as page, cast(row_number() over (partition by group_id, variant order by line) as int) as line, text from (select group_id, kind, variant, line, {_trim(f"regexp_replace({_CANON}, '[ \t\n\f\r]+', ' ', 'g')")} as text from sl) where text <> '')"""
_PIPELINE = f"""{_NORMAL}, {folds.weighted(f"select group_id, page, line, lower(vt) as k, vt, cast(1 as float) as w from (select distinct group_id, page, line, variant, {_VARIANT} as vt from nl) where vt <> '' qualify row_number() over (partition by group_id, page, line, lower(vt), variant order by vt) = 1", 0.9)},
        hd as (select group_id, cast(count(distinct variant) as int) as iterations from nl group by 1),
        dc as (select group_id, cast(sum(convergence_bps) // count(*) as int) as conv, sum(numeric_conflicts) as nc from p group by 1),
        nb as (select r.group_id, r.page, r.line, t, lead(t) over (partition by r.group_id, r.page, r.line order by rank) as u from r semi join (select * from dc where nc > 0) using (group_id)),
        ac as (select distinct group_id, page, line, greatest(0, line - 2) as s, line + 2 as e from nb where {_DIFFERS.format(a='t', b='u')}),
        bf as (select *, max(e) over (partition by group_id, page order by line rows between unbounded preceding and 1 preceding) as before from ac),
        gp as (select *, sum(case when before is null or s > before + 1 then 1 else 0 end) over (partition by group_id, page order by line rows unbounded preceding) as g from bf),
        rg as (select group_id, page, greatest(min(s), 1) as a, max(e) as b from gp group by group_id, page, g),
        again as (select rg.group_id, rg.page, nl.line, arg_min(text, (a, b, text)) as text from rg join nl on nl.group_id = rg.group_id and nl.page = rg.page and kind = 'high_contrast' and nl.line between a and b group by all),
        ins as (select group_id, page, line, t from (select *, {_bare_words('text')} as t from again) where t <> ''),
        sd as (select group_id, page, line, {folds.ranked("list_transform(cs, lambda c: list_resize([c.t], cast(c.n as int), c.t))")} as gs from p semi join rg using (group_id)),
        rf as ({folds.inserted("select group_id, page, line, coalesce(gs, []) as gs, t from sd full join ins using (group_id, page, line)")}),
        ct as (select group_id, page, line, {folds.winner('gs2')} as winner, len(gs2[1]) * 10000 // list_sum(list_transform(gs2, lambda g: len(g))) as c from rf),
        st as (select group_id, page, line, winner from p anti join rg using (group_id) union all select group_id, page, line, winner from ct),
        sc as (select group_id, cast(sum(c) // count(*) as int) as conv from ct group by 1),
        ln as (select group_id, list({{'line': n, 'page': 1, 'text': winner}} order by n) as lines from (select group_id, winner, cast(row_number() over (partition by group_id order by line) as int) as n from st) group by 1),
        dd as (select group_id, {_uuid5(NAMESPACE_URL, 'group_id')} as document_id, cast(iterations + case when sc.conv is null then 0 else 1 end as int) as iterations, coalesce(sc.conv, dc.conv) as conv from dc join hd using (group_id) left join sc using (group_id))"""

_IMAGES = """
        im as (select cast(vec_id as varchar) as image_id, cast(len(embedding) // 8 as int) as height, embedding from embeddings where embedding is not null),
        px as (select image_id, height, i, cast(greatest(0, least(255, floor(cast(embedding[i + 1] as double) * 64 + 128))) as int) as v from im, unnest(range(0, len(embedding))) as u(i))"""


def _otsu(pixels: str) -> str:
    """CTEs up to th (image_id, threshold) of rows (image_id, v)."""
    return f"""
        hn as (select image_id, v as t, count(*)::double as n from {pixels} group by all),
        hw as (select *, sum(n) over (partition by image_id order by t) as b, sum(n * t) over (partition by image_id order by t) as s, sum(n) over (partition by image_id) as a, sum(n * t) over (partition by image_id) as u from hn),
        hv as (select image_id, t, case when a > b then b * (a - b) * pow(s / b - (u - s) / (a - b), 2) end as v from hw),
        th as (select image_id, cast(coalesce(arg_max(t, (v, -t)) filter (v > 0), 128) as int) as threshold from hv group by 1)"""


ORACLE = {
    "lines_scan": f"""
        with t as (select doc_id, list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: {_trim('x')}), lambda x: x <> '') as l from documents where text is not null)
        select doc_id, cast(i as int) as line, l[i] as text from t, unnest(range(1, len(l) + 1)) as u(i)""",
    "lines_keep_blank": f"""
        with t as (select doc_id, list_transform(string_split_regex(text, '\r?\n'), lambda x: {_trim('x')}) as l, text = '' or text like '%\n' as last from documents where text is not null)
        select doc_id, cast(i as int) as line, l[i] as text from t, unnest(range(1, len(l) + case when last then 0 else 1 end)) as u(i)""".replace("'%\n'", "'%' || chr(10)"),
    "document_text": "select group_id, variant, string_agg(text, chr(10) order by page, line, text) as text from ocr_lines group by all",
    "normalize_canonical": f"select * from (select line_id, {_CANON} as text from ocr_lines) where text <> ''",
    **{f"normalize_{name}": _normal(name) for name in PROFILES},
    "vote_keys": f"select line_id, {_VARIANT} as variant_text, lower({_VARIANT}) as vote_key, {_WEIGHT} as weight from ocr_lines",
    "incremental_normalize": rf"select line_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}' || substr('{_WS}', 2, length('{_WS}') - 2) || ']', '', 'g'), '{_WS}+', ' ', 'g')) as plain from ocr_lines",
    "single_votes": f"""
        with v as (select group_id, page, line, lower({_VARIANT}) as key, {_VARIANT} as variant, {_WEIGHT} as weight, coalesce(source, '') as source from ocr_lines where text is not null),
        o as (select *, row_number() over (partition by group_id, page, line, key, source order by variant, weight desc) as rn from v where variant <> '')
        select group_id, page, line, key, source, variant, weight from o where rn = 1""",
    "positions_fuzzy": f"with recursive {folds.weighted(_votes(False), 0.9)} select group_id, page, line, winner, convergence_bps, ambiguity_bps, votes, collisions, negation_conflicts, numeric_conflicts, array_to_string(list_transform(cs, lambda c: c.t || '#' || c.n), ' ; ') as clusters from p",
    "reduce_documents": f"""
        with recursive {_documents(False, 0.9)},
        wt as (select group_id, string_agg(winner, chr(10) order by page, line, winner) as winner_text from p group by 1) select * from d join wt using (group_id)""",
    "reduce_strict": f"with recursive {_documents(False, 0.95)} select * from d",
    "plurality_positions": f"with recursive {_COUNTED} select group_id, page, line_index, winner, largest, total, {folds.MEMBERS} as groups from pl",
    "plurality_metrics": f"with recursive {_COUNTED} select group_id, convergence_bps, 10000 - convergence_bps as ambiguity_bps from pm",
    "plurality_pages": f"""
        with recursive {_COUNTED}
        select group_id, cast(dense_rank() over (partition by group_id order by page) as int) as page_no, cast(row_number() over (partition by group_id, page order by line_index) as int) as line_no, winner as text from pl""",
    "roi_clusters": f"""
        with recursive {_COUNTED}, nb as (select group_id, page, line_index, g[j] as a, g[j + 1] as b from (select group_id, page, line_index, unnest(gs) as g from pl), unnest(range(1, len(g))) as u(j))
        select distinct group_id, page, line_index + 1 as line, 'NumericConflict' as reason from nb where {_DIFFERS.format(a='a', b='b')}""",
    "replay_positions": f"with recursive {_REPLAYED} select group_id, page, line_index, winner, largest, total, {folds.MEMBERS} as groups from pl",
    "replay_checkpoint": f"with recursive {_REPLAYED} select group_id, page, line_index, winner, largest, total, {folds.MEMBERS} as groups from pl",
    "replay_genesis": f"""
        with recursive {_REPLAYED}, hd as (select group_id, count(*) filter (applied) as applied_events, count(*) filter (not applied) as skipped_events, 'event://' || arg_min(id, (timestamp, id)) filter (applied) as source from el group by 1)
        select group_id, applied_events, skipped_events, source, applied_events as iterations, coalesce(convergence_bps, 0) as convergence_bps, 10000 - coalesce(convergence_bps, 0) as ambiguity_bps from hd left join pm using (group_id)""",
    "replay_equivalence": f"""
        with recursive {_REPLAYED}, hd as (select group_id, count(*) filter (applied) as iterations, 'event://' || arg_min(id, (timestamp, id)) filter (applied) as source from el group by 1)
        select group_id, source, iterations, coalesce(convergence_bps, 0) as convergence_bps, 10000 - coalesce(convergence_bps, 0) as ambiguity_bps, true as equivalent from hd left join pm using (group_id)""",
    "pipeline_snapshots": f"""
        with recursive {_PIPELINE}
        select {_uuid5(NAMESPACE_URL, "'snapshot#' || group_id")} as snapshot_id, document_id, {_uuid5(NAMESPACE_OID, "cast(to_json({'document_id': document_id, 'iterations': iterations, 'lines': lines}) as varchar)")} as content_hash,
            cast(conv / 10000 as float) as confidence, iterations, cast(len(lines) as int) as n_lines from dd join ln using (group_id)""",
    "stored_pipeline": f"""
        with recursive {_PIPELINE},
        rw as (select group_id, variant, kind, string_agg(text, chr(10) order by line, text) as raw_text from sl group by all),
        nr as (select group_id, variant, string_agg(text, chr(10) order by line, text) as normalized_text from nl group by all)
        select {_uuid5(NAMESPACE_URL, "concat_ws('#', 'observation', group_id, variant, raw_text)")} as observation_id, {_uuid5(NAMESPACE_URL, 'group_id')} as document_id, group_id as source, rw.kind as variant, raw_text, coalesce(normalized_text, '') as normalized_text, 'tesseract' as kind,
            {_uuid5(NAMESPACE_URL, "'snapshot#' || group_id")} as snapshot_id from rw left join nr using (group_id, variant)""",
    "jsonl_events": "select id, coalesce(schema_version, -1) as schema_version, timestamp, source, payload, document_id from ocr_events",
    "replay_latest": f"""
        with recursive {_REPLAYED},
        hd as (select group_id, count(*) filter (applied) as iterations, count(*) filter (applied and timestamp > {CUT}) as ta, count(*) filter (not applied and timestamp > {CUT}) as ts, count(*) filter (applied) as ga, count(*) filter (not applied) as gs0,
            'event://' || arg_min(id, (timestamp, id)) filter (applied) as source from el group by 1),
        ck as (select distinct group_id from el where applied and timestamp <= {CUT} and {_bare_words('text')} <> '')
        select {_uuid5(NAMESPACE_URL, 'source')} as group_id, case when ck.group_id is null then ga else ta end as applied_events, case when ck.group_id is null then gs0 else ts end as skipped_events, source, iterations,
            coalesce(convergence_bps, 0) as convergence_bps, 10000 - coalesce(convergence_bps, 0) as ambiguity_bps, case when ck.group_id is null then 'genesis' else 'checkpoint+tail' end as mode
        from hd left join ck using (group_id) left join pm using (group_id) where source is not null""",
    "image_variants": f"""
        with {_IMAGES}, {_otsu('px')}
        select image_id, 'original' as variant, 8 as width, height, -1 as threshold, cast(null as float) as resize_factor, 8 as roi_width, height as roi_height, -1 as n_white from im
        union all
        select image_id, 'high_contrast', 8, height, threshold, null, 8, height, cast(count(*) filter (v > threshold) as int) from px join th using (image_id) group by all
        union all
        select image_id, 'rotated', 8, height, -1, cast(0.6 as float), 4, greatest(1, cast(floor(cast(height as float) * cast(0.6 as float)) as int)), -1 from im""",
    "image_regions": f"""
        with {_IMAGES},
        ro as (select * from (values ('title_block', 1, 2, 5, 4, 0, 0), ('signature', 5, 6, 9, 9, 0, 0), ('invoice_totals', 0, 0, 5, 4, 10, 8)) as t(kind, x, y, w, h, rw, rh)),
        cr as (select px.image_id || '#' || kind as image_id, px.image_id as own, kind, x, y, rw, rh, least(w, 8 - x) as cw, least(h, height - y) as ch, v from px, ro where i % 8 >= x and i % 8 < x + w and i // 8 >= y and i // 8 < y + h), {_otsu('cr')}
        select own as image_id, kind, kind || '_' || x || '_' || y as name, cast(case when rw > 0 then rw else cw end as int) as width, cast(case when rh > 0 then rh else ch end as int) as height, threshold, cast(case when rw > 0 then rw / cw end as float) as resize_factor,
            cast(cw as int) as roi_width, cast(ch as int) as roi_height, cast(case when max(rw) = 0 then count(*) filter (v > threshold) else -1 end as int) as n_white from cr join th using (image_id) group by own, kind, x, y, rw, rh, cw, ch, threshold""",
    "image_readings": f"""
        with {_IMAGES}, {_otsu('px')},
        wh as (select image_id, height, count(*) filter (v = 255) as a, count(*) filter (v > threshold) as b from px join th using (image_id) group by all)
        select image_id as source, variant, line, case line when 1 then 'size 8 ' || height else 'white ' || case variant when 'original' then a else b end end as text
        from wh, (values ('original'), ('high_contrast')) as v(variant), (values (1), (2)) as l(line)""",
    "jw_pairs": f"with {_PAIRS} select a, b, round({folds.similarity('a', 'b')}, 6) as similarity from x",
    "reduce_exact": f"with recursive {_documents(False, 1.0)} select * from d",
    "reduce_exact_shared": f"with recursive {_documents(True, 1.0)} select * from d",
    "positions_exact": f"with recursive {folds.weighted(_votes(True), 1.0)} select group_id, page, line, winner, convergence_bps, ambiguity_bps, votes, collisions, n_clusters from p",
    "alternatives": f"with recursive {_RUN} select group_id, page, line, cast(rank as int) as rank, t as text, cast(w as double) as total_weight, cast(n as int) as n from r",
    "winner_runner_up": f"with recursive {_RUN} select a.group_id, a.page, a.line, a.t as winner, b.t as runner_up, cast(cast(a.w - b.w as float) as double) as lead from r a join r b using (group_id, page, line) where a.rank = 1 and b.rank = 2",
    "semantic_veto_pairs": rf"""
        with {_PAIRS},
        n as (select *, regexp_extract_all(a, '[0-9.]*[0-9][0-9.]*') as na, regexp_extract_all(b, '[0-9.]*[0-9][0-9.]*') as nb, list_contains(string_split(a, ' '), 'non') as ga, list_contains(string_split(b, ' '), 'non') as gb from x)
        select a, b, case when ga <> gb then 'negation' when len(na) > 0 and len(nb) > 0 and na <> nb then 'numeric' end as veto, regexp_matches(a, '[\x{{0400}}-\x{{04FF}}]') = regexp_matches(b, '[\x{{0400}}-\x{{04FF}}]') as same_script,
            {_DIFFERS.format(a='a', b='b')} as differs_in_numbers from n""",
    "key_traits": rf"""
        with k as (select line_id, lower({_VARIANT}) as k from ocr_lines where text is not null)
        select line_id, array_to_string(regexp_extract_all(k, '[0-9.]*[0-9][0-9.]*'), ' ') as numbers, list_contains(string_split(k, ' '), 'non') as negated, regexp_matches(k, '[\x{{0400}}-\x{{04FF}}]') as cyrillic from k""",
    "fields_projection": f"with recursive {_RUN}, {_FIELDS} select group_id, 'page_' || page || '_line_' || n as field, text from f",
    "snapshot_lines": f"with recursive {_RUN}, {_FIELDS} select group_id, po as page, n as line, text from f",
    "cluster_groups": f"with recursive {_RUN} select group_id, page, line - 1 as line_index, array_to_string(flatten(list(list_resize([t], cast(n as int), t) order by rank)), '|') as members from r group by group_id, page, line",
    "snapshot_documents": f"""
        with recursive {_SNAP}
        select {_uuid5(NAMESPACE_URL, 'group_id')} as snapshot_id, document_id, {_uuid5(NAMESPACE_OID, "cast(to_json({'document_id': document_id, 'iterations': iterations, 'lines': lines}) as varchar)")} as content_hash,
            cast(convergence_bps / 10000 as float) as confidence, iterations, cast(len(lines) as int) as n_lines from d join j using (group_id)""",
    "observations": f"""
        with recursive {_SNAP}
        select {_uuid5(NAMESPACE_URL, 'group_id')} as id, document_id, 'reducer.document' as field, source as value, cast(convergence_bps / 10000 as float) as confidence, iterations, status,
            case status when 'Ambiguous' then 'ambiguity_high' else 'reducer_failed' end as reason_code,
            case status when 'Ambiguous' then 'ambiguity_score_bps=' || ambiguity_bps || ' convergence_score_bps=' || convergence_bps else 'pages=' || n_pages || ' iterations=' || iterations end as note, cast(null as varchar) as invalid
        from d where status <> 'Converged'""",
    "document_uuid": f"select distinct source, {_uuid5(NAMESPACE_URL, 'source')} as document_id from ocr_lines where source is not null",
    "content_hash": f"""
        with l as (select snapshot_id, list({{'line': line, 'page': page, 'text': text}} order by page, line, text) as lines, cast(count(*) as int) as n from snapshot_lines group by all)
        select snapshot_id, {_uuid5(NAMESPACE_OID, "cast(to_json({'document_id': snapshot_id, 'iterations': n, 'lines': lines}) as varchar)")} as content_hash from l""",
    "roi_atomic": f"with recursive {_ROIS} select * from z",
    "roi_merged": f"with recursive {_ROIS} select * from m2",
    "roi_plan": f"""
        with recursive {_ROIS}, g3 as (select group_id, cast(sum(atomic_count) as int) as atomic_count, cast(count(*) as int) as n_regions, cast(sum(line_end - line_start + 1) as int) as n_lines,
            list({{'page': page, 'line_start': line_start, 'line_end': line_end, 'dominant_reason': dominant_reason}} order by page, line_start, line_end) as regions from m2 group by group_id)
        select group_id, atomic_count, n_regions, n_lines, sha256(cast(to_json({{'group_id': group_id, 'atomic_count': atomic_count, 'regions': regions}}) as varchar)) as plan_hash from g3""",
    "roi_refine": f"""
        with recursive {_ROIS}, t as (select group_id, variant, page, line, min(text) as text from ocr_lines where text is not null group by all),
        i as (select m.group_id, m.page, t.line, t.text, greatest(line_start, 1) as a, line_end as b from m2 m join t on t.group_id = m.group_id and t.page = m.page and t.variant = case preprocess_hint when 'Original' then 'original' else 'high_contrast' end and t.line between greatest(line_start, 1) and line_end where t.text <> '')
        select group_id, page, line, arg_min(text, (a, b, text)) as text from i group by all""",
    "latest_snapshot": f"select {_plain('document_id')} as document_id, arg_max(snapshot_id, (created_at, arrived_at, snapshot_id)) as snapshot_id, max(created_at) as created_at from snapshot_metadata where document_id is not null group by 1",
    "events_after_snapshot": f"""
        with c as (select {_plain('document_id')} as g, greatest(0, cast(floor(epoch(max(created_at))) as bigint)) as cut from snapshot_metadata where document_id is not null group by 1),
        e as (select {_plain('document_id')} as g, timestamp from ocr_events where document_id is not null)
        select g as group_id, count(*) as n_events, min(timestamp) as first from e left join c using (g) where cut is null or timestamp > cut group by 1""",
    "replace_into": "select snapshot_id, max(export_no) as export_no from document_snapshots group by 1",
    "ignore_into": "select snapshot_id, min(export_no) as export_no from document_snapshots group by 1",
    "snapshot_with_lines": """
        with h as (select distinct snapshot_id from document_snapshots), l as (select snapshot_id, cast(count(*) as int) as n_lines, string_agg(text, chr(10) order by page, line, text) as text from snapshot_lines group by 1)
        select snapshot_id, coalesce(n_lines, 0) as n_lines, text from h left join l using (snapshot_id)""",
    "duplicate_positions": "select snapshot_id, page, line, count(*) as n_rows from snapshot_lines group by all having count(*) > 1",
    "otsu_threshold": """
        with n as (select l_returnflag as image_id, cast(l_quantity as int) * 5 + case when l_linestatus = 'O' then 3 else 0 end as t, count(*)::double as n from lineitem group by all),
        w as (select *, sum(n) over (partition by image_id order by t) as b, sum(n * t) over (partition by image_id order by t) as s, sum(n) over (partition by image_id) as a, sum(n * t) over (partition by image_id) as u from n),
        v as (select image_id, t, b * (a - b) * pow(s / b - (u - s) / (a - b), 2) as v from w where a > b)
        select image_id, cast(coalesce(arg_max(t, (v, -t)), 128) as int) as threshold from v group by 1""",
    "rehydrate_snapshots": f"""
        with recursive {_SNAP},
        n2 as (select group_id, page, line, cast(max(n) * 10000 // sum(n) as bigint) as c from r group by all),
        m as (select group_id, cast(cast(sum(c) // count(*) as int) / 10000 as float) as recount from n2 group by all)
        select document_id, case when abs(recount - cast(convergence_bps / 10000 as float)) > 1e-4 then 'confidence_mismatch' end as as_written, cast(null as varchar) as recounted from d join m using (group_id)""",
    "event_lines": f"""
        with e as (select {_plain('document_id')} as group_id, id, timestamp, try_cast(source as json) as s, try_cast(payload as json) as p from ocr_events where document_id is not null)
        select group_id, id, timestamp, coalesce(try_cast(s->>'$.OcrVariant.page' as int), 0) as page, coalesce(try_cast(s->>'$.OcrVariant.line_index' as int), 0) as line_index, coalesce(p->>'$.OcrLine.text', '') as text,
            coalesce(json_type(s->'$.OcrVariant') = 'OBJECT', false) and coalesce(json_type(p->'$.OcrLine') = 'OBJECT', false) as applied from e""",
    "events_from_lines": f"""
        select group_id, {_uuid5(NAMESPACE_OID, "concat_ws('#', group_id, variant, page, line, text, 1771113600 + line_id)")} as id, page, line - 1 as line_index, text, variant, true as applied
        from ocr_lines where text is not null""",
}
