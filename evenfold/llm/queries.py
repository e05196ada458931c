"""Queries of the text problems 1, 3, 7, 8, 9 and 10, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenfold.functions.ids import plain_uuid
from evenfold.llm import fieldhash, leaks, lookalike, mixing, scannoise, spans
from evenfold.session import table


def _readings(spark: SparkSession, d: str):
    yield "ocr_lines", table(spark, d, "ocr_lines").withColumn("group_id", plain_uuid("group_id")), ["group_id", "variant"]
    yield "snapshot_lines", table(spark, d, "snapshot_lines").withColumn("snapshot_id", plain_uuid("snapshot_id")), ["snapshot_id"]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Every line that repeats an earlier one of its reading or snapshot in another dress."""
    parts = [fieldhash.copies(rows, by).select(F.lit(name).alias("table_name"), "first_line_id", "line_id") for name, rows, by in _readings(spark, d)]
    return parts[0].unionByName(parts[1])


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct line once, with the number of its copies."""
    parts = [fieldhash.counts(rows, by).select(F.lit(name).alias("table_name"), "first_line_id", "n_copies") for name, rows, by in _readings(spark, d)]
    return parts[0].unionByName(parts[1])


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """Documents with leaks, without the leaked stretches."""
    return leaks.clean(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the mixture reaches."""
    targets = table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(table(spark, d, "documents"), targets), targets)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "documents"))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document stands elsewhere too."""
    return spans.shared_shares(table(spark, d, "documents"))


def text_fields(spark: SparkSession, d: str) -> DataFrame:
    """The text fields of problem 1: table_name, field_name, record_id, page, line, text."""
    seen = table(spark, d, "raw_observations")
    parts = [seen.select(F.lit("raw_observations").alias("table_name"), F.lit(f).alias("field_name"), plain_uuid("observation_id").alias("record_id"), F.lit(0).alias("page"), F.lit(0).alias("line"), F.col(f).alias("text")) for f in ("raw_text", "normalized_text")]
    lines = table(spark, d, "snapshot_lines").select(F.lit("snapshot_lines").alias("table_name"), F.lit("text").alias("field_name"), plain_uuid("snapshot_id").alias("record_id"), F.col("page").cast("int"), F.col("line").cast("int"), "text")
    return parts[0].unionByName(parts[1]).unionByName(lines)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.found(text_fields(spark, d))


def p1_unified(spark: SparkSession, d: str) -> DataFrame:
    """All text fields in one consistent form."""
    return lookalike.unify(text_fields(spark, d))


def _scanned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    texts = table(spark, d, "raw_observations").select(plain_uuid("observation_id").alias("record_id"), F.col("raw_text").alias("text"))
    return texts, table(spark, d, "ocr_lines")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    texts, lines = _scanned(spark, d)
    bc = scannoise.ship(texts.select("text").unionByName(lines.select("text")))
    parts = (("raw_observations", scannoise.text_noise(texts, bc)), ("ocr_lines", scannoise.line_noise(lines, bc)))
    a, b = (found.select(F.lit(name).alias("table_name"), "record_id", "line_no", "kind") for name, found in parts)
    return a.unionByName(b)


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Continuous paragraphs: one row for each row of raw_observations (record_id is its observation_id, variant null) and for each reading
    in ocr_lines (record_id is its group_id)."""
    texts, lines = _scanned(spark, d)
    known = scannoise.ship(texts.select("text").unionByName(lines.select("text")))
    whole = scannoise.repair(texts, known).select(F.lit("raw_observations").alias("table_name"), "record_id", F.lit(None).cast("string").alias("variant"), "text")
    readings = scannoise.repair_readings(lines.withColumn("group_id", plain_uuid("group_id")), known)
    return whole.unionByName(readings.select(F.lit("ocr_lines").alias("table_name"), F.col("group_id").alias("record_id"), "variant", "text"))


QUERIES = {
    "p3_found": p3_found, "p3_repaired": p3_repaired,
    "p1_found": p1_found, "p1_unified": p1_unified, "p10_found": p10_found, "p10_shares": p10_shares,
    "p7_found": p7_found, "p7_counts": p7_counts, "p8_found": p8_found, "p8_clean": p8_clean, "p9_mixture": p9_mixture, "p9_shares": p9_shares,
}

def _copies(name: str, by: str) -> str:
    # RE2 has no look-around: marks between digits are turned into letters that no text has, one to one, and each pass covers every other gap.
    t = "replace(lower(text), 'ß', 'ss')"
    for _ in range(2):
        t = rf"regexp_replace({t}, '(\p{{Nd}})([^\p{{L}}\p{{N}}\p{{Z}}\t\n\x0b\x0c\r\x{{85}};|])(\p{{Nd}})', '\1ꙮ\2ꙮ\3', 'g')"
    word = r"([\p{L}\p{N}]|ꙮ.ꙮ)+"
    return rf"""
        select '{name}' as table_name, line_id, concat_ws('/', {by}) as reading,
            list_sort(list_filter(list_transform(string_split_regex({t}, '[;|]'), lambda f: array_to_string(regexp_extract_all(f, '{word}'), ' ')), lambda f: f <> '')) as k
        from {name} where text is not null"""


_SHARED = """
        w as (select doc_id, i, md5_number(substring(text, i + 1, 400)) as h from documents, unnest(range(0, length(text) - 399)) as t(i)),
        m as (select h from w group by h having min(doc_id) <> max(doc_id)),
        s as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 400 then 0 else 1 end as o from w semi join m using (h)),
        g as (select *, sum(o) over (partition by doc_id order by i) as g from s),
        f as (select doc_id, min(i) as start_pos, max(i) + 400 as end_pos from g group by doc_id, g)"""

ORACLE = {
    "p10_found": f"with {_SHARED} select doc_id, start_pos, end_pos from f",
    "p10_shares": f"""
        with {_SHARED}, n as (select doc_id, cast(sum(end_pos - start_pos) as bigint) as shared_chars from f group by 1)
        select doc_id, coalesce(length(text), 0) as n_chars, coalesce(shared_chars, 0) as shared_chars,
            case when coalesce(length(text), 0) > 0 then coalesce(shared_chars, 0) / length(text) else 0.0 end as share
        from documents left join n using (doc_id) where doc_id is not null""",
    "p7_found": f"""
        with n as ({_copies('ocr_lines', 'group_id, variant')} union all {_copies('snapshot_lines', 'snapshot_id')}),
        m as (select table_name, line_id, min(line_id) over (partition by table_name, reading, k) as first_line_id from n where len(k) > 0)
        select table_name, first_line_id, line_id from m where line_id <> first_line_id group by all""",
    "p7_counts": f"""
        with n as ({_copies('ocr_lines', 'group_id, variant')} union all {_copies('snapshot_lines', 'snapshot_id')})
        select table_name, min(line_id) as first_line_id, count(distinct line_id) as n_copies from n where len(k) > 0 group by table_name, reading, k""",
    "p8_found": r"""
        with w as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from eval_items),
        g as (select distinct item_id, array_to_string(w[i : i + 11], ' ') as g from w, unnest(range(1, len(w) - 10)) as t(i)),
        d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null),
        h as (select doc_id, array_to_string(w[i : i + 11], ' ') as g from d, unnest(range(1, len(w) - 10)) as t(i))
        select distinct item_id, doc_id from h join g using (g)""",
    "p8_clean": r"""
        with w as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from eval_items),
        g as (select distinct array_to_string(w[i : i + 11], ' ') as g from w, unnest(range(1, len(w) - 10)) as t(i)),
        d as (select doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null),
        h as (select doc_id, i, array_to_string(w[i : i + 11], ' ') as g from d, unnest(range(1, len(w) - 10)) as t(i)),
        l as (select doc_id, list(distinct k) as ks from (select doc_id, unnest(range(i, i + 12)) as k from h semi join g using (g)) group by doc_id),
        c as (select doc_id, ks, regexp_extract_all(text, '[\p{L}\p{N}]+') as w, string_split_regex(text, '[\p{L}\p{N}]+') as gap from d join l using (doc_id))
        select doc_id, case when len(ks) <= 0.5 * len(w) then gap[1] || array_to_string(list_transform(range(1, len(w) + 1),
            lambda k: case when list_contains(ks, k) then '' else w[k] end || case when list_contains(ks, k) and list_contains(ks, k + 1) then '' else gap[k + 1] end), '') end as text, cast(len(ks) as bigint) as n_removed from c""",
}
