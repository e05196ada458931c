"""Messages, ledger, drift and export differences on small tables with odd rows."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evenfold.operators import drift, ledger, messages, snapdiff
from evenfold.operators.ledger import Ledger, StaleWriter, changed, first_seen, process, replay_runs

U = "0197a1b2-c3d4-7e5f-8a6b-0c1d2e3f4a{:02x}"


def test_repeated_messages(spark):
    rows = [(U.format(1),), (U.format(1).upper(),), ("{" + U.format(2) + "}",), (None,), (None,), ("odd",), (" odd",), ("",)]
    got = messages.repeated(spark.createDataFrame(rows, "id string"), "id").collect()
    assert {(r.message_id, r.n_rows) for r in got} == {(U.format(1), 2), ("odd", 2)}
    assert messages.repeated(spark.createDataFrame([], "id string"), "id").count() == 0


def test_seen_ranges():
    rng = random.Random(3)
    for _ in range(50):
        seen, state = set(), messages.SeenRanges()
        for _ in range(200):
            if rng.random() < 0.1:
                lo = rng.randrange(150)
                hi = lo + rng.randrange(20)
                state.add(lo, hi)
                seen |= {*range(lo, hi + 1)}
            else:
                n = rng.randrange(150)
                assert state.accept(n) is (n not in seen)
                seen.add(n)
        assert {n for lo, hi in zip(state.lo, state.hi, strict=True) for n in range(lo, hi + 1)} == seen
        assert all(b > a + 1 for a, b in zip(state.hi, state.lo[1:], strict=False))


@pytest.mark.parametrize("size", [3, 10_000])
def test_ranges_decide(spark, monkeypatch, size):
    """Producers' numbers over several batches, Arrow batches of any size: what the ranges don't cover is accepted once, from the first batch that has it."""
    monkeypatch.setattr(messages, "BLOCK_BITS", 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    rng = random.Random(5)
    rows = [(rng.choice("pq"), rng.randrange(60), rng.choice([None, 1, 2, 3]), f"m{i % 7}") for i in range(300)] + [("p", None, 1, "bad"), ("p", None, 2, "bad"), ("p", None, None, "worse")]
    df = spark.createDataFrame(rows, "p string, n long, batch int, id string")
    got = messages.deliveries(messages.identify(df, "id", "p", "n"), "batch").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    first, count = {}, {}
    for p, n, b, i in rows:
        k = (p, n) if n is not None else i
        first[k], count[k] = min(first.get(k, 9), b or 0), count.get(k, 0) + 1
    assert len(got) == len(first) and sorted((max(r._batch, 0), r.rejected) for r in got) == sorted((first[k], count[k] - 1) for k in first)


def test_repeats_come_from_the_ranges(spark, monkeypatch):
    """Without the ranges a second batch's copies would pass."""
    df = spark.createDataFrame([(U.format(1), 1), (U.format(1), 2), (U.format(2), 1)], "id string, batch int")
    taken = messages.deliveries(messages.identify(df, "id"), "batch").where("rejected > 0")
    assert taken.count() == 1
    wide = spark.createDataFrame([(0, 0, 1 << 20)], "_producer long, lo long, hi long")
    seen = messages.deliveries(messages.identify(spark.createDataFrame([("p", 70_000), ("p", 1 << 21)], "p string, n long").withColumn("id", F.lit("m")), "id", "p", "n").withColumn("_producer", F.lit(0).cast("long")), None, wide)
    assert {(r._n, r._batch, r.rejected) for r in seen.collect()} == {(70_000, None, 1), (1 << 21, 0, 0)}


def test_accept_keeps_whole_rows(spark):
    """Columns without an order, clashing names, ties and repeated rows."""
    rows = [(U.format(1), 1, {"a": "x"}, "k"), (U.format(1), 1, {"a": "y"}, "k"), (U.format(1), 1, {"a": "x"}, "k"), (U.format(2), None, None, None)]
    df = spark.createDataFrame(rows, "id string, batch int, _row map<string,string>, _key string")
    assert sorted((r.id[-1], r._row) for r in messages.accept(df, "id", ["batch"]).collect()) == [("1", {"a": "x"}), ("2", None)]
    assert messages.accept(df.limit(0), "id", ["batch"]).count() == 0


def test_accept_over_batches(spark):
    schema = "id string, batch int, body string, _h string"
    a = spark.createDataFrame([(U.format(1).upper(), 1, "x", None), (U.format(1), 1, "y", "c"), ("odd", 1, "z", None), (None, 1, "n", None)], schema)
    b = spark.createDataFrame([(U.format(1), 2, "late", None), (U.format(2), 2, "w", None), ("odd", 2, "z", None)], schema)
    first = messages.accept(a, "id", ["batch"])
    assert sorted(r.body for r in first.collect()) == ["n", "x", "z"]
    seen = messages.identify(first, "id")
    kept = messages.accept(b, "id", ["batch"], messages.merge_ranges(seen), seen.where("_key is not null").select("_key"))
    assert [r.body for r in kept.collect()] == ["w"]


def test_ranges_of_producers(spark):
    rng = random.Random(2)
    numbers = {("p", n) for n in rng.sample(range(300_000), 2000)} | {("p", n) for n in range(65_000, 140_000)} | {("q", 5), ("q", 7)}
    df = spark.createDataFrame(list(numbers) * 2, "p string, n long").withColumn("id", F.lit("m"))
    got = messages.merge_ranges(messages.identify(df, "id", "p", "n"))
    spans = {}
    for r in got.collect():
        spans.setdefault(r._producer, []).append((r.lo, r.hi))
    for s in spans.values():
        s.sort()
        assert all(b[0] > a[1] + 1 for a, b in zip(s, s[1:], strict=False))
    assert sum(hi - lo + 1 for s in spans.values() for lo, hi in s) == len(numbers)
    more = messages.merge_ranges(got.unionByName(got))
    assert more.count() == got.count()


T0 = datetime(2026, 3, 1)


def test_ledger_leases():
    led = Ledger()
    hour = timedelta(hours=1)
    a = led.lease("t", T0, 1, T0, T0 + hour)
    with pytest.raises(StaleWriter):
        led.lease("t", T0, 2, T0, T0 + hour)  # still leased
    led.expire(T0 + hour)
    old, path = a.token, a.path
    b = led.lease("t", T0 + hour, 2, T0 + hour, T0 + 2 * hour)
    assert b.path == path
    with pytest.raises(StaleWriter):
        led.commit(a, old)  # fenced
    led.commit(b, b.token)
    assert led.high_water("t") == T0 + hour and led.lease("t", T0, 3, T0 + 2 * hour, T0 + 3 * hour) is None
    assert Ledger.loads(led.dumps()) == led


def test_ledger_is_stored_once(spark, tmp_path):
    """Of two processes that saw the same version one stores the next; the other one starts from there."""
    a, b = ledger.Store(spark, str(tmp_path)), ledger.Store(spark, str(tmp_path))
    (x, v), (y, w) = a.read(), b.read()
    assert v == w == 0
    x.lease("t", T0, 1, T0, T0 + timedelta(days=1))
    y.lease("t", T0, 2, T0, T0 + timedelta(days=1))
    assert a.swap(x, v) and not b.swap(y, w)
    with pytest.raises(StaleWriter):
        b.lease("t", T0, 2, T0, T0 + timedelta(days=1))  # sees the lease of the other one
    assert b.read()[0] == x
    for n in range(12):
        b.update(lambda led: led.items.setdefault(f"u{n}", []))  # noqa: B023
    assert len(a._versions()) <= 9 and len(a.read()[0].items) == 13


@pytest.mark.parametrize("few", [256, 1])
def test_runs_and_records(spark, monkeypatch, few):
    monkeypatch.setattr(ledger, "FEW", few)
    h = lambda n: T0 + timedelta(hours=n)
    runs = [(1, "t", h(1), "succeeded"), (2, "t", h(2), "failed"), (3, "t", h(3), "succeeded"), (3, "t", h(3), "succeeded"), (4, "t", h(2), "succeeded"), (5, "t", None, "succeeded"), (6, "t", h(6), "running"), (7, "t", h(7), "succeeded"), (None, "t", h(9), "succeeded"), (8, "u", h(1), None)]
    items = replay_runs(spark.createDataFrame(runs, "run_id long, table_name string, cutoff_at timestamp_ntz, status string"))
    assert [(i.run_id, i.after, i.upto) for i in items] == [(1, None, h(1)), (3, h(1), h(3)), (7, h(3), h(7))]
    rows = [("a", h(1), 1), ("a", h(2), 1), ("a", h(5), 2), ("a", h(6), None), ("b", h(2), 1), ("b", h(4), 2), ("b", h(5), 1), ("c", h(8), 1), (None, h(1), 1), ("d", None, 1)]
    df = spark.createDataFrame(rows, "id string, arrived_at timestamp_ntz, v int")
    assert {tuple(r) for r in first_seen(df, F.col("id"), items).collect()} == {("a", 1), ("b", 3)}
    assert {tuple(r) for r in changed(df, F.col("id"), items, ["v"]).collect()} == {("a", 1), ("b", 3), ("a", 7)}
    assert first_seen(df, F.col("id"), []).count() == 0


def test_process_leaves_one_copy(spark, tmp_path, monkeypatch):
    """A killed attempt, a stale writer and a crash between commit and publication leave every record once, read from the folder."""
    df = spark.createDataFrame([(1, T0), (2, T0 + timedelta(hours=1)), (3, T0 + timedelta(hours=2))], "x int, arrived_at timestamp_ntz")
    store = ledger.Store(spark, str(tmp_path))
    folder = lambda: sorted(r.x for r in spark.read.option("recursiveFileLookup", True).schema("x int").parquet(f"{tmp_path}/t").collect())
    hour = timedelta(hours=1)
    lost = store.lease("t", T0, 1, T0, T0)
    df.limit(2).write.parquet(store.attempt_path(lost, lost.token))  # killed before its commit
    item = store.lease("t", T0 + hour, 2, T0, T0 + timedelta(days=1))
    assert item.path == lost.path and item.token > lost.token
    with pytest.raises(StaleWriter):
        process(df, lost, store, lambda rows: rows)  # comes back late
    path = process(df, item, store, lambda rows: rows)
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == [1, 2] == folder()
    with pytest.raises(StaleWriter):
        process(df, lost, store, lambda rows: rows)
    assert folder() == [1, 2]
    item = store.lease("t", T0 + 2 * hour, 3, T0, T0 + timedelta(days=1))
    monkeypatch.setattr(ledger.Store, "publish", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        process(df, item, store, lambda rows: rows)
    monkeypatch.undo()
    assert folder() == [1, 2]
    store.publish(store.read()[0].items["t"])
    assert folder() == [1, 2, 3]


def test_history_is_read_from_its_folder(spark, tmp_path):
    runs = [(1, "t", T0, True), (2, "t", T0 + timedelta(hours=1), False), (3, "t", T0 + timedelta(hours=2), True), (4, "t", T0 + timedelta(hours=3), True), (5, "t", T0 + timedelta(hours=1), True)]
    rows = spark.createDataFrame([("a", 1), ("b", 3), ("a", 3)], "record_id string, run_id long")
    store = ledger.Store(spark, str(tmp_path))
    got = ledger.process_history({"t": rows, "u": rows.limit(0)}, runs, store)
    assert sorted(tuple(r) for r in got.collect()) == [("t", 1, "a"), ("t", 3, "a"), ("t", 3, "b")]
    assert [i.run_id for i in store.read()[0].items["t"]] == [1, 3, 4]


def records(spark, files):
    rows = [("ocr_event", 1, f, n, b if isinstance(b, str) or b is None else json.dumps(b)) for f, bodies in files.items() for n, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "record_type string, producer_id long, file_no int, record_no int, body string")


def test_drift(spark):
    base = {"id": "0197a1b2-c3d4-7e5f-8a6b-0c1d2e3f4a5b", "schema_version": 1, "p": {"text": "some words", "n": 3}, "ok": True}
    files = {
        1: [base, base, "{cut", None, "[1]"],
        300: [{**base, "schema_version": 2}, {"id": base["id"], "schema_version": 2, "p": {"n": None, "text": None}, "ok": None}],
        301: [{"id": base["id"], "schemaVersion": 2, "p": {"Text": "more words", "n": 2.5}, "ok": False, "tags": []}],
        302: [{"id": base["id"], "schemaVersion": "2", "p": {"Text": "more words", "n": 2.5}, "tags": [1]}],
        303: ["{", None],
        304: [{"id": base["id"], "schemaVersion": "2", "p": {"Text": "words again", "n": 1.5}, "tags": [1], "is_retry": True}],
    }
    got = {(r.file_no, r.change_kind, r.old_name, r.new_name) for r in drift.changes(records(spark, files)).collect()}
    assert got == {
        (301, "renamed", "schema_version", "schemaVersion"), (301, "renamed", "p.text", "p.Text"), (301, "added", "", "tags"), (301, "type_changed", "p.n", "p.n"),
        (302, "type_changed", "schemaVersion", "schemaVersion"), (302, "removed", "ok", ""), (304, "added", "", "is_retry"),
    }
    assert drift.changes(records(spark, {1: [base]}).limit(0)).count() == 0
    spelled = {1: [{"schema_version": "2", "a": 1}], 2: [{"version": "v3", "a": 1}]}
    assert [(r.change_kind, r.new_name) for r in drift.changes(records(spark, spelled)).collect()] == [("renamed", "version")]


def test_ingest_and_promote(spark):
    df = records(spark, {1: [{"id": "a", "n": 1, "x": "y"}, {"id": 5, "num": 2.0}, {"id": "c", "n": "7"}, "{", {"id": "d", "n": 2.5}, {"id": "e", "n": 1, "num": 4}]})
    got = drift.ingest(df, "ocr_event", {"id": ("string", "id"), "n": ("long", "n")}).orderBy("record_no")
    rows = got.collect()
    assert [(r.id, r.n, r._rescued) for r in rows] == [("a", 1, '{"x": "y"}'), (None, None, '{"id": 5, "num": 2.0}'), ("c", 7, None), ("d", None, '{"n": 2.5}'), ("e", 1, '{"num": 4}')]
    more = drift.promote(got, {"x": ("string", ["x"]), "n": ("long", ["num"]), "m": ("double", ["n"])}).orderBy("record_no").collect()
    assert [r.x for r in more] == ["y", None, None, None, None] and [r.n for r in more] == [1, 2, 7, None, 1] and [r.m for r in more] == [None, None, None, 2.5, None]
    assert [r._rescued for r in more] == [None, '{"id": 5}', None, None, '{"num": 4}']  # a value that is there isn't overwritten


def test_names_are_learned(spark):
    """Renames lead rescued values back to the target's columns, over several steps, and never join two of them."""
    body = lambda **x: {"document_id": "0197a1b2-c3d4-7e5f-8a6b-0c1d2e3f4a5b", "iterations": 3, **x}
    files = {1: [body(schema_version=1)], 2: [body(schemaVersion=2)], 3: [body(version=2, dpi=300)], 4: ["{"], 5: [body(version="3", dpi="x")]}
    df = records(spark, files).withColumn("record_type", F.lit("reducer_state"))
    names = drift.learned_names(drift.changes(df), drift.TARGETS["reducer_state"])
    assert names["schema_version"] == ("long", ["schemaVersion", "version"]) and names["iterations"] == ("long", [])
    got = drift.consistent_table(df, "reducer_state").orderBy("file_no").collect()
    assert [(r.schema_version, r.dpi, r._rescued) for r in got] == [(1, None, None), (2, None, None), (2, 300, None), (3, None, '{"dpi": "x"}')]
    assert drift.consistent_table(df.limit(0), "reducer_state").count() == 0
    both = spark.createDataFrame([("renamed", "iterations", "n"), ("renamed", "iterations", "n"), ("renamed", "pages", "n")], "change_kind string, old_name string, new_name string")
    got = drift.learned_names(both, drift.TARGETS["reducer_state"])
    assert got["iterations"][1] == ["n"] and got["pages"][1] == []


def test_export_differences(spark):
    heads = [(1, "A1", "s1"), (1, "a1", "s1"), (1, "b", "s2"), (1, "c", "s3"), (2, "a1", "s1b"), (2, "b", "s2x"), (2, "d", "s4"), (3, "a1", "s1b"), (3, "b", "s2x"), (3, "d", "s5"), (3, "c", "s3"), (3, None, "s9")]
    uid = {"A1": U.format(1).upper(), "a1": U.format(1), "b": U.format(2), "c": U.format(3), "d": U.format(4), None: None}
    snaps = spark.createDataFrame([(e, uid[d], s, T0) for e, d, s in heads], "export_no int, document_id string, snapshot_id string, created_at timestamp_ntz")
    lines = [("s1", 1, 1, "x"), ("s1", 1, 2, None), ("s1b", 1, 2, None), ("s1b", 1, 1, "x"), ("s1b", 1, 1, "x"), ("s2", 1, 1, "x"), ("s2x", 1, 1, "x "), ("s4", 1, 1, "q")]
    got = snapdiff.document_changes(snaps, spark.createDataFrame(lines, "snapshot_id string, page int, line int, text string")).collect()
    assert {(r.export_no, r.document_id, r.change_kind) for r in got} == {(2, uid["b"], "changed"), (2, uid["c"], "removed"), (2, uid["d"], "added"), (3, uid["c"], "added"), (3, uid["d"], "changed")}
    assert snapdiff.document_changes(snaps.limit(0), spark.createDataFrame(lines, "snapshot_id string, page int, line int, text string")).count() == 0


def test_ordinals_persist(spark, tmp_path):
    keys = spark.createDataFrame([(i % 3, f"k{i}") for i in range(50)] + [(2, "k0"), (None, "k1"), (1, None)], "export_no int, key string")
    grown = None
    for e in (0, 1, 2):
        new = snapdiff.ordinals(keys.where(F.col("export_no") == e), grown, 4)
        before = {} if grown is None else {r.key: r.ordinal for r in grown.collect()}
        snapdiff.store_dictionary(new, str(tmp_path))
        grown = snapdiff.load_dictionary(spark, str(tmp_path))
        after = {r.key: (r.bucket, r.ordinal) for r in grown.collect()}
        assert all(after[k][1] == o for k, o in before.items()) and len({*after.values()}) == len(after)
    assert after == {r.key: (r.bucket, r.ordinal) for r in snapdiff.ordinals(keys.where("export_no is not null"), None, 4).collect()}
    assert snapdiff.load_dictionary(spark, str(tmp_path / "none")) is None


def test_known_ordinals_change_nothing(spark):
    """Against sets, with a dictionary that knows some keys and others that are gone."""
    rng = random.Random(7)
    rows = [(e, f"k{k}", rng.randrange(3), 0, 1) for e in (1, 2, 5) for k in range(60) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "export_no int, key string, d1 long, d2 long, n long")
    at = {e: {k: d for x, k, d, *_ in rows if x == e} for e in (1, 2, 5)}
    want = set()
    for a, b in ((1, 2), (2, 5)):
        want |= {(b, k, "added") for k in at[b].keys() - at[a].keys()} | {(b, k, "removed") for k in at[a].keys() - at[b].keys()} | {(b, k, "changed") for k in at[a].keys() & at[b].keys() if at[a][k] != at[b][k]}
    known = snapdiff.ordinals(spark.createDataFrame([(f"k{k}",) for k in range(40, 90)], "key string"), None, 8)
    for start in (None, known):
        got, dictionary = snapdiff.diff(df, start, 8)
        assert {tuple(r) for r in got.collect()} == want and dictionary.count() == len({r[1] for r in rows} | ({f"k{k}" for k in range(40, 90)} if start is not None else set()))
