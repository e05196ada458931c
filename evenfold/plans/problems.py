"""Queries of the general problems 2, 4, 5 and 6."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenfold.functions.ids import plain_uuid
from evenfold.operators import drift, ledger, messages, snapdiff
from evenfold.session import checkpoint_dir, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Messages that stand on more than one row of their table."""
    parts = [
        messages.repeated(table(spark, d, name), key, "batch_no").select(F.lit(name).alias("table_name"), "message_id")
        for name, key in (("raw_observations", "observation_id"), ("ocr_events", "id"))
    ]
    return parts[0].unionByName(parts[1])


def p2_kept_events(spark: SparkSession, d: str) -> DataFrame:
    """One row of each event: the first delivered, of rows delivered together the one with the least ids."""
    kept = messages.accept(table(spark, d, "ocr_events"), "id", ["batch_no", "arrived_at", "id", "document_id"])
    return kept.select("id", "timestamp", "source", "payload", "batch_no", "arrived_at")


def p2_kept_observations(spark: SparkSession, d: str) -> DataFrame:
    kept = messages.accept(table(spark, d, "raw_observations"), "observation_id", ["batch_no", "arrived_at"])
    return kept.select(plain_uuid("observation_id").alias("observation_id"), "batch_no")


def p2_seen_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of the numbers seen of each producer of raw_records: a file's records are numbered."""
    rows = table(spark, d, "raw_records").withColumn("producer", F.concat_ws("/", "record_type", F.col("producer_id").cast("string"), F.col("file_no").cast("string")))
    made = messages.identify(rows, "file_name", producer="producer", number="record_no")
    return messages.merge_ranges(made).groupBy().agg(F.count(F.lit(1)).alias("n_ranges"), F.sum(F.col("hi") - F.col("lo") + 1).alias("n_numbers"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that each succeeded run must process, without the first succeeded run of each table: the log worked off through a ledger of its own."""
    runs = ledger.runs_of(table(spark, d, "ingest_runs"))
    done = ledger.Ledger().replay(runs)
    results, first = {}, F.lit(False)
    for name, key, compare in (("ocr_events", "id", None), ("snapshot_metadata", "snapshot_id", ["content_hash", "confidence", "iterations"])):
        items = [i for i in done if i.table == name]
        rows = table(spark, d, name)
        results[name] = ledger.changed(rows, plain_uuid(key), items, compare) if compare else ledger.first_seen(rows, plain_uuid(key), items)
        first = first | ((F.col("table_name") == name) & (F.col("run_id") == (items[0].run_id if items else -1)))
    store = ledger.Store(spark, f"{checkpoint_dir(spark)}/loads-{uuid.uuid4().hex}")
    return ledger.process_history(results, runs, store).where(~first)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "raw_records"))


def _p5_table(record_type: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return drift.consistent_table(table(spark, d, "raw_records"), record_type)

    return query


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Two runs over one stored dictionary: the first export gives its documents their ordinals, the later ones go on from there."""
    snapshots, lines = table(spark, d, "document_snapshots"), table(spark, d, "snapshot_lines")
    root = f"{checkpoint_dir(spark)}/ordinals-{uuid.uuid4().hex}"
    first = snapshots.where(F.col("export_no") == snapshots.agg(F.min("export_no")).first()[0]).select(F.col("export_no").cast("int"), plain_uuid("document_id").alias("key"))
    snapdiff.store_dictionary(snapdiff.ordinals(first), root)
    return snapdiff.document_changes(snapshots, lines, snapdiff.load_dictionary(spark, root))


QUERIES = {
    "p2_found": p2_found, "p2_kept_events": p2_kept_events, "p2_kept_observations": p2_kept_observations, "p2_seen_ranges": p2_seen_ranges,
    "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found,
    "p5_ocr_event": _p5_table("ocr_event"), "p5_document_snapshot": _p5_table("document_snapshot"), "p5_reducer_state": _p5_table("reducer_state"),
}

_UUID = r"""regexp_replace(lower({c}), '(^\s*\{{?\s*(urn:uuid:)?)|(\}}?\s*$)|-', '', 'g')"""


def _plain(c: str) -> str:
    h = _UUID.format(c=c)
    return f"(case when regexp_matches({h}, '^[0-9a-f]{{32}}$') then regexp_replace({h}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') else trim({c}) end)"


ORACLE = {
    "p2_found": f"""
        select 'raw_observations' as table_name, {_plain('observation_id')} as message_id from raw_observations where observation_id is not null group by 2 having count(*) > 1
        union all
        select 'ocr_events', {_plain('id')} from ocr_events where id is not null group by 2 having count(*) > 1""",
    "p2_kept_observations": f"""
        select {_plain('observation_id')} as observation_id, min(batch_no) as batch_no from raw_observations group by 1""",
    "p2_kept_events": f"""
        select id, timestamp, source, payload, batch_no, arrived_at from (select *, row_number() over (partition by {_plain('id')} order by batch_no, arrived_at, id, document_id nulls first) as k from ocr_events) where k = 1""",
    "p2_seen_ranges": """
        with n as (select distinct record_type, producer_id, file_no, record_no from raw_records where record_no is not null),
        i as (select record_no - row_number() over (partition by record_type, producer_id, file_no order by record_no) as g, * from n)
        select count(distinct (record_type, producer_id, file_no, g)) as n_ranges, cast((select count(*) from n) as bigint) as n_numbers from i""",
    "p4_found": f"""
        with r as (select distinct run_id, table_name, cutoff_at from ingest_runs where status = 'succeeded' and cutoff_at is not null),
        m as (select *, max(cutoff_at) over (partition by table_name order by run_id rows between unbounded preceding and 1 preceding) as high from r),
        w as (select *, row_number() over (partition by table_name order by run_id) as k from m where high is null or cutoff_at > high),
        e as (select {_plain('id')} as record_id, min(arrived_at) as seen from ocr_events where id is not null group by 1),
        s as (select distinct w.run_id, {_plain('snapshot_id')} as record_id, arrived_at, content_hash, confidence, iterations from snapshot_metadata s join w on w.table_name = 'snapshot_metadata' and s.arrived_at <= w.cutoff_at and (w.high is null or s.arrived_at > w.high)),
        l as (select run_id, record_id, arg_max({{'c': content_hash, 'f': confidence, 'i': iterations}}, arrived_at) as v from s group by 1, 2),
        p as (select *, lag(v) over (partition by record_id order by run_id) as b, row_number() over (partition by record_id order by run_id) as n from l)
        select 'ocr_events' as table_name, run_id, record_id from e join w on w.table_name = 'ocr_events' and seen <= cutoff_at and (high is null or seen > high) where k > 1
        union all
        select 'snapshot_metadata', run_id, record_id from p where (n = 1 or v is distinct from b) and run_id not in (select run_id from w where table_name = 'snapshot_metadata' and k = 1)""",
    "p6_found": f"""
        with h as (select export_no, {_plain('document_id')} as document_id, max(snapshot_id) as snapshot_id from document_snapshots group by 1, 2),
        t as (select snapshot_id, list_sort(list(distinct (page, line, text))) as lines from snapshot_lines group by 1),
        x as (select export_no, document_id, lines from h left join t using (snapshot_id))
        select b.export_no, b.document_id, case when a.document_id is null then 'added' else 'changed' end as change_kind from x b left join x a on a.export_no = b.export_no - 1 and a.document_id = b.document_id
            where b.export_no > 1 and (a.document_id is null or a.lines is distinct from b.lines)
        union all
        select a.export_no + 1, a.document_id, 'removed' from x a left join x b on b.export_no = a.export_no + 1 and a.document_id = b.document_id
            where b.document_id is null and a.export_no < (select max(export_no) from x)""",
}
