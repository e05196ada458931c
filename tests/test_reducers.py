"""Weighted and counted reduction against scores worked out by hand, and their invariants."""

import random

import pytest
from pyspark.sql import functions as F

from evenfold.functions import similarity
from evenfold.functions.ids import NAMESPACE_URL, uuid5
from evenfold.operators import plurality, replay, roi, snapshots, weighted
from evenfold.plans import core, pipeline
from evenfold.schema import LINES, PROFILES
from evenfold.sources import text as texts


def lines(spark, rows):
    """rows: (source, [texts by line]) or with (text, confidence) pairs; one group, one page."""
    out = []
    for source, body in rows:
        for n, t in enumerate(body, 1):
            t, c = t if isinstance(t, tuple) else (t, None)
            out.append(("g", source, source, 1, n, t, c))
    return spark.createDataFrame(out, LINES)


def reduced(spark, rows, threshold=0.90):
    documents, positions = weighted.reduce_documents(lines(spark, rows), threshold, "shared")
    d = documents.first()
    return d, {(r.page, r.line): r for r in positions.collect()}


@pytest.mark.parametrize("rows,conv,amb,coll,extra", [
    ([("a", ["45,20"]), ("b", ["45,20"]), ("c", ["45.20"])], 10000, 0, 6666, {"winner": "45.20"}),
    ([("a", [("ABC", 0.95)]), ("b", [("ABD", 0.40)]), ("c", [("ABD", 0.30)])], 5758, 4242, 3333, {"winner": "ABC"}),
    ([("a", [("A", 0.5)]), ("b", [("B", 0.5)])], 5000, 5000, 0, {"winner": "A"}),
])
def test_hand_worked(spark, rows, conv, amb, coll, extra):
    d, p = reduced(spark, rows)
    assert (d.convergence_bps, d.ambiguity_bps, d.collision_rate_bps) == (conv, amb, coll)
    assert p[1, 1].winner == extra["winner"]


TITLE = [  # fixed values: one title block as three variants read it
    ("a", ["05/06/2020 DESCRIZIONE :", "NOME FILE :", "MATERIALE :", "ss", "NUM. DISEGNO", "FOGLIO 1 DI 1"]),
    ("b", ["05/06/2020 DESCRIZIONE :", "NOME FILE :", "MATERIALE :", "rss", "NUM. DISEGNO", "FOGLIO 1 DI 1"]),
    ("c", ["05/06/2020", "TBCSS", "NOME FILE", "DIM. FOGLIO : NUM. DISEGNO", "A3", "1 dor)", "FOGLIO 1 DI i"]),
]
# fixed values: one page of which a reading has a line too many
GHOST = [("a", ["Document Title", "Line 1 content", "Line 2 content", "Line 3 content", "Footer text"]), ("b", ["Document Title", "Line 1 content", "Line 2 content", "Line 3 content", "Footer text"]),
         ("c", ["Document Title", "Line 1 content", "Line 2 content", "Line 3 content", "GHOST LINE artifact", "Footer text"])]
# fixed values: amounts as three readings spell them
MONEY = [("a", ["Currency Conversion Examples", "Amount in Euro: €1000.00", "Amount in USD: 1000 USD", "Amount in EUR: 1000 EUR"]),
         ("b", ["Currency Conversion Examples", "Amount in Euro: 1000.00 €", "Amount in USD: USD 1000", "Amount in EUR: EUR 1000"]),
         ("c", ["Currency Conversion Examples", "Amount in Euro: €1000", "Amount in USD: 1000 USD", "Amount in EUR: 1000 EUR"])]


def weighed(rows, weights):
    return [(s, [(t, w) for t in body]) for (s, body), w in zip(rows, weights, strict=True)]


# fixed values: the scores (convergence, ambiguity, collisions) and conflicts (negation, numeric) of these readings
@pytest.mark.parametrize("rows,scores,conflicts", [
    (TITLE, (6666, 2856, 2631), (0, 0)), (weighed(TITLE, [0.90, 0.88, 0.72]), (7028, 3474, 2631), (0, 0)),
    ([("s", body) for _, body in TITLE], (5476, 4047, 0), (0, 0)),
    (GHOST, (9444, 555, 5625), (0, 0)), ([("s", body) for _, body in GHOST], (9166, 833, 0), (0, 0)),
    (MONEY, (9166, 833, 5833), (0, 1)),
    (weighed([(s, [t]) for s, t in zip("abcd", ["Stato: pagato"] * 2 + ["Stato: non pagato"] * 2, strict=True)], [0.95, 0.90, 0.92, 0.88]), (5068, 9863, 5000), (1, 0)),
    (weighed([(s, [t]) for s, t in zip("abcd", ["PIVA: 12345678901"] * 2 + ["PIVA: 12345678907"] * 2, strict=True)], [0.94, 0.93, 0.92, 0.91]), (5054, 9892, 5000), (0, 1)),
])
def test_goldens(spark, rows, scores, conflicts):
    d, _ = reduced(spark, rows)
    assert (d.convergence_bps, d.ambiguity_bps, d.collision_rate_bps) == scores and (d.negation_conflicts, d.numeric_conflicts) == conflicts


def test_vetoes(spark):
    d, _ = reduced(spark, [("a", [("il documento non è pagato oggi", 0.9)]), ("b", [("il documento è pagato oggi", 0.8)])])
    assert (d.negation_conflicts, d.numeric_conflicts) in ((1, 0), (0, 0))
    d, _ = reduced(spark, [("a", ["TRF-ID 2026/001 EUR"]), ("b", ["TRF-ID 2027/001 EUR"])])
    assert d.numeric_conflicts == 1 and d.collision_rate_bps == 0
    d, _ = reduced(spark, [("a", ["ciao mondo ciao"]), ("b", ["сiao mondo ciao"])])  # a Cyrillic letter
    assert d.collision_rate_bps == 0


def test_same_source_votes_once(spark):
    d, p = reduced(spark, [("a", ["x", "y"]), ("a", ["x", "z"])])
    assert p[1, 1].votes == 1 and p[1, 2].votes == 2


def test_odd_weights_nulls_and_blanks(spark):
    d, p = reduced(spark, [("a", [("x", float("nan")), ("y", None)]), ("b", [("w", 0.1), (None, 1.0)]), ("c", [("  ", 1.0), ("​", 1.0)])])
    assert p[1, 1].winner == "w" and p[1, 2].winner == "y" and d.n_positions == 2
    d, p = reduced(spark, [("a", [("x", float("inf"))])])
    assert (p[1, 1].convergence_bps, p[1, 1].ambiguity_bps) == (0, 0)


def test_empty(spark):
    documents, positions = weighted.reduce_documents(spark.createDataFrame([], LINES))
    assert documents.count() == 0 and positions.count() == 0


def test_order_and_partitions_play_no_part(spark):
    rng = random.Random(5)
    words = ["total due 45.20", "total duo 45.20", "totai due 45.20", "totale 45.20", "non pagato", "pagato"]
    rows = [("g", f"s{rng.randrange(6)}", "v", rng.randint(1, 2), rng.randint(1, 3), rng.choice(words), rng.choice([0.25, 0.5, 1.0])) for _ in range(120)]
    want = None
    for parts in (1, 3, 7):
        rng.shuffle(rows)
        docs, pos = weighted.reduce_documents(spark.createDataFrame(rows, LINES).repartition(parts), source_mode="shared")
        got = (docs.collect(), sorted(pos.drop("clusters").collect()))
        want = want or got
        assert got == want
    assert all(0 <= r.convergence_bps <= 10000 and 0 <= r.ambiguity_bps <= 10000 for r in want[1])


def test_many_copies_are_one_cluster(spark):
    d, p = reduced(spark, [(f"s{i}", ["Invoice number 2026/001 total"]) for i in range(1000)])
    assert p[1, 1].votes == 1000 and len(p[1, 1].clusters) == 1 and p[1, 1].clusters[0]["count"] == 1000


def test_extra_columns_do_no_harm(spark):
    rows = lines(spark, [("a", ["x"]), ("b", ["x"])]).withColumns({"key": F.lit("k"), "weight": F.lit(9), "cast": F.lit(1), "v": F.lit("w"), "n": F.lit(0)})
    assert weighted.reduce_documents(rows)[0].first().convergence_bps == 10000


def test_counted_votes(spark):
    rows = spark.createDataFrame([("g", 1, 0, "Total 10", 1), ("g", 1, 0, "total 10", 2), ("g", 1, 0, "nothing alike", 3), ("g", 1, 2, "x", 4), ("g", 3, 0, "y", 5), ("g", 3, 1, "!!", 6), ("g", 3, 1, None, 7)], "group_id string, page int, line_index int, text string, o int")
    folded = plurality.fold(rows, [F.col("o")])
    m = plurality.metrics(folded).first()
    assert (m.convergence_bps, m.ambiguity_bps) == ((6666 + 10000 + 10000) // 3, 10000 - (6666 + 20000) // 3)
    assert sorted((r.page_no, r.line_no, r.text) for r in plurality.pages(folded).collect()) == [(1, 1, "total 10"), (1, 2, "x"), (2, 1, "y")]
    assert plurality.fold(rows.limit(0), [F.col("o")]).count() == 0


def test_counted_fold_resumes(spark):
    rng = random.Random(3)
    rows = [("g", 1, rng.randrange(3), rng.choice(["alpha beta", "alpha bata", "alpho beta", "gamma"]), i) for i in range(60)]
    df = spark.createDataFrame(rows, "group_id string, page int, line_index int, text string, o int")
    whole = {(r.page, r.line_index): r.groups for r in plurality.fold(df, [F.col("o")]).collect()}
    head = plurality.fold(df.where("o < 30"), [F.col("o")]).select("group_id", "page", "line_index", "groups")
    both = {(r.page, r.line_index): r.groups for r in plurality.fold(df.where("o >= 30"), [F.col("o")], head).collect()}
    marked = plurality.fold(df, [F.col("o")], late=F.col("o") >= 30).collect()
    assert {(r.page, r.line_index): r.groups for r in marked if r.at_cut} == {(r.page, r.line_index): r.groups for r in head.collect()}
    assert {(r.page, r.line_index): r.groups for r in marked if not r.at_cut} == whole
    assert whole == both


def test_regions(spark):
    rois = [("g", 1, 1, "Ambiguity"), ("g", 1, 5, "NumericConflict"), ("g", 1, 30, "DenseCluster"), ("g", 2, 1, "NumericConflict")]
    got = sorted(roi.merge(spark.createDataFrame(rois, "group_id string, page int, line int, reason string"), 2).collect())
    assert [(r.page, r.line_start, r.line_end, r.dominant_reason, r.atomic_count, r.preprocess_hint) for r in got] == [
        (1, 0, 7, "NumericConflict", 2, "HighContrast"), (1, 28, 32, "DenseCluster", 1, "Original"), (2, 0, 3, "NumericConflict", 1, "HighContrast")]
    groups = [("g", 1, 0, [[("id 2026", 2), ("id 2027", 1)]]), ("g", 1, 1, [[("a", 1)], [("b 1", 3)]]), ("g", 1, 2, [[]]), ("g", 1, 3, [])]
    df = spark.createDataFrame(groups, f"group_id string, page int, line_index int, groups {plurality.GROUPS}")
    assert [tuple(r) for r in roi.numeric_conflicts(df).collect()] == [("g", 1, 1, "NumericConflict")]
    regions = roi.merge(spark.createDataFrame(rois, "group_id string, page int, line int, reason string"), 2)
    src = spark.createDataFrame([("g", "high_contrast", 1, n, f"t{n}") for n in range(1, 9)], "group_id string, variant string, page int, line int, text string")
    assert sorted(r.line for r in roi.refine(regions, src).collect()) == [1, 2, 3, 4, 5, 6, 7]


def test_snapshot_checks(spark):
    docs, pos = weighted.reduce_documents(lines(spark, [("a", ["x", "y"]), ("b", ["x", "y"])]), source_mode="shared")
    good = snapshots.snapshots(docs, pos, F.lit("s"), F.lit("2026-01-01").cast("timestamp")).cache()
    err = lambda df, p="tesseract": snapshots.rehydrate(df, PROFILES[p]).first().error
    assert err(good) is None
    assert err(good.withColumn("schema_version", F.lit(2))) == "schema_version"
    assert err(good.withColumn("rehydration", F.lit(None).cast(good.schema["rehydration"].dataType))) == "rehydration_missing"
    assert err(good.withColumn("document_id", F.lit("x"))) == "document_mismatch"
    assert err(good.withColumn("confidence", F.lit(0.5).cast("float"))) == "confidence_mismatch"
    assert err(good.withColumn("content_hash", F.lit("x"))) == "content_hash_mismatch"
    twice = good.withColumn("lines", F.concat("lines", "lines"))
    assert err(twice, "strict") == "duplicate_position" and err(twice) == "content_hash_mismatch"
    rows = [([(1, 1, "a"), (1, 2, "b")],), ([(1, 2, "b"), (1, 1, "a")],), ([(1, 1, "a"), (1, 1, "a"), (1, 2, "b")],)]
    h = [r[0] for r in spark.createDataFrame(rows, "l array<struct<page: int, line: int, text: string>>").select(snapshots.content_hash(F.lit("d"), F.lit(1), F.col("l"))).collect()]
    assert h[0] == h[1] != h[2]


def test_profiles(spark):
    rows = spark.createDataFrame([("g", "v", 1, 1, "  ", None), ("g", "v", 1, 2, "A  b", 0.95), ("g", "v", 1, 3, "c", None), ("g", "v", 1, 4, None, 1.0)], "group_id string, variant string, page int, line int, text string, confidence float")
    assert [(r.line, r.text) for r in texts.normalize(rows, PROFILES["strict"]).orderBy("line").collect()] == [(1, "c")]  # 0.95 as a float is below 0.95
    assert [(r.line, r.text) for r in texts.normalize(rows, PROFILES["tesseract"]).orderBy("line").collect()] == [(1, "A b"), (2, "c")]


def test_line_scans(spark):
    df = spark.createDataFrame([(1, " a\r\n\n b \n"), (2, ""), (3, None)], "doc_id int, text string")
    assert sorted(map(tuple, texts.to_lines(df, ["doc_id"]).collect())) == [(1, 1, "a"), (1, 2, "b")]
    assert sorted(map(tuple, texts.to_lines_keep_blank(df, ["doc_id"]).collect())) == [(1, 1, "a"), (1, 2, ""), (1, 3, "b")]


def event(i, t, page, line, text, doc="d"):
    return (f"{i:04d}", 1, t, f'{{"OcrVariant":{{"variant":"original","page":{page},"line_index":{line}}}}}', f'{{"OcrLine":{{"text":"{text}","confidence":0.5}}}}', 0.5, doc)


EV = "id string, schema_version int, timestamp bigint, source string, payload string, confidence float, document_id string"


def test_replay(spark):
    rng = random.Random(1)
    rows = [event(i, rng.randrange(100), rng.randrange(1, 4), rng.randrange(4), rng.choice(["total 10", "totai 10", "due now", "!!"])) for i in range(200)]
    rows += [("x1", 1, 5, '"Reducer"', "{}", 0.5, "d"), ("x2", 1, 5, "{broken", "{}", 0.5, "d"), ("x3", 1, 5, None, None, None, None)]
    df = spark.createDataFrame(rows, EV)
    _, docs = replay.replay(df, "document_id")
    d = docs.first()
    assert d.applied_events == 200 and d.skipped_events == 2 and docs.count() == 1
    again = replay.replay(df.repartition(5), "document_id")[1].first()
    assert again == d
    for at in (0, 50, 99):
        assert [r.equivalent for r in replay.equivalent(df, "document_id", at).collect()] == [True]


def test_replay_goes_on_from_its_checkpoint(spark):
    """Source and iterations are carried over; a document without later events stays."""
    line = lambda i, t, doc, text, at=0: (f"0197a1b2-c3d4-7e5f-8a6b-0c1d2e3f4a{i:02x}", t, '{"OcrVariant":{"variant":"original","page":1,"line_index":%d}}' % at, '{"OcrLine":{"text":"%s","confidence":1.0}}' % text, doc)  # noqa: E731, UP031
    rows = [line(1, 10, "a", "total 12"), line(2, 20, "a", "total 12"), line(3, 30, "a", "total 13"), line(4, 5, "b", "alone"), line(5, 40, "c", "late"), ("x", 50, '"Reducer"', '{"Observation":{}}', "a")]
    df = spark.createDataFrame(rows, "id string, timestamp long, source string, payload string, document_id string")
    head, heads = replay.replay(df.where("timestamp <= 20"), "document_id")
    got = {r.group_id: r for r in replay.replay(df.where("timestamp > 20"), "document_id", head, heads)[1].collect()}
    whole = {r.group_id: r for r in replay.replay(df, "document_id")[1].collect()}
    for doc in "abc":
        assert (got[doc].source, got[doc].iterations, got[doc].convergence_bps) == (whole[doc].source, whole[doc].iterations, whole[doc].convergence_bps)
    assert got["a"].applied_events == 1 and got["a"].skipped_events == 1 and got["b"].applied_events == 0
    same = replay.equivalent(df, "document_id", 20).collect()
    assert len(same) == 3 and all(r.equivalent for r in same) and {r.group_id: r.iterations for r in same} == {"a": 3, "b": 1, "c": 1}
    with pytest.raises(ValueError, match="beyond"):
        replay.equivalent(df, "document_id", 51)


def test_events_of_lines(spark):
    rows = lines(spark, [("a", ["x", ("y", 0.5)])])
    made = replay.events_of(rows, F.lit(7).cast("long"))
    assert sorted((r.page, r.line_index, r.text, r.applied) for r in replay.lines_of(made, "document_id").collect()) == [(1, 0, "x", True), (1, 1, "y", True)]
    assert sorted(r.confidence for r in made.collect()) == [0.0, 0.5] and made.select("id").distinct().count() == 2
    seen = spark.createDataFrame([("i", "d", 0.5, "Failed")], "id string, document_id string, confidence float, status string")
    assert [r.applied for r in replay.lines_of(replay.observation_events(seen, F.lit(7).cast("long")), "document_id").collect()] == [False]


def test_streaming_replay_equals_batch(spark, tmp_path):
    from evenfold.streaming import replay as stream

    rows = [event(i, i, 1 + i % 2, i % 3, ["total 10", "totai 10", "due now"][i % 3]) for i in range(90)]
    df = spark.createDataFrame(rows, EV)
    for k in range(3):
        df.where(f"timestamp >= {k * 30} and timestamp < {k * 30 + 30}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = stream.read_events(spark, str(tmp_path / "in"), df.schema)
    q = stream.write_positions(stream.positions(source, "document_id"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    last = {(r.page, r.line_index): (r.winner, r.total) for r in got.orderBy("total").collect()}
    want = {(r.page, r.line_index): (r.winner, r.total) for r in replay.replay(df, "document_id")[0].collect()}
    assert last == want


def test_pipeline(spark, tmp_path):
    rows = [("a.png", "original", "TOTAL 10\nID 2026-1 ref"), ("a.png", "high_contrast", "TOTAL 10\nID 2027-1 ref"), ("a.png", "rotated", "TOTAI 10\nID 2026-1 ref"), ("b.png", "original", ""), (None, "original", "x")]
    made = pipeline.process(spark.createDataFrame(rows, "source string, variant string, text string"), F.lit("2026-01-01").cast("timestamp"))
    assert made.raw_observations.count() == 3
    assert {r.page for r in made.regions.collect()} == {1}
    snap = made.snapshots.first()
    assert [x["text"] for x in snap.lines] == ["TOTAL 10", "ID 2026-1 ref"]
    pipeline.persist(made, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store/snapshots")).count() == 1


def test_refinement_settles_the_document(spark):
    """A numeric veto plans regions; the hinted variant's lines go into the state, which the snapshot is made from: one iteration more, scores by counts."""
    rows = [("a.png", "original", "Total due 2026-1 ref\nzeta"), ("a.png", "high_contrast", "Total due 2027-1 ref\nzeta"), ("b.png", "original", "calm\nsea"), ("b.png", "high_contrast", "calm\nsea")]
    made = pipeline.process(spark.createDataFrame(rows, "source string, variant string, text string"), F.lit("2026-01-01").cast("timestamp"))
    docs = {r.group_id: r for r in made.documents.collect()}
    assert docs["a.png"].numeric_conflicts == 1 and docs["a.png"].iterations == 3 and docs["b.png"].iterations == 2
    assert docs["a.png"].convergence_bps == (6666 + 10000) // 2 and docs["b.png"].convergence_bps == 10000
    snap = {r.rehydration.source: r for r in made.snapshots.collect()}
    # votes and rereadings are compared in lower case without marks, so the reread text is a member of its own
    assert [x["text"] for x in snap["b.png"].lines] == ["calm", "sea"] and len(snap["a.png"].lines) == 2 and snap["a.png"].iterations == 3
    assert {r.group_id for r in made.regions.collect()} == {"a.png"}
    assert [r.error for r in snapshots.rehydrate(made.snapshots).collect()] == [None, None]


def test_images_to_snapshots(spark):
    """Images to variants to PNG to a provider to the reducer, in one plan."""
    import zlib

    def provider(content, lang, variant):
        at, data = 8, b""
        while at < len(content):
            size, kind = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
            data += content[at + 8 : at + 8 + size] if kind == b"IDAT" else b""
            at += 12 + size
        return f"{lang} page\nbright {sum(b > 127 for b in zlib.decompress(data))}"

    images = spark.createDataFrame([("a.png", 4, 2, bytearray([10] * 4 + [200] * 4)), ("bad", 3, 3, bytearray(2))], "image_id string, width int, height int, pixels binary")
    readings = pipeline.read_documents(images, "ita", provider)
    assert sorted((r.variant, r.text) for r in readings.where("variant <> 'rotated'").collect()) == [("high_contrast", "ita page\nbright 4"), ("original", "ita page\nbright 4")]
    made = pipeline.process(readings, F.lit("2026-01-01").cast("timestamp"))
    assert [x["text"] for x in made.snapshots.first().lines][0] == "ita page" and made.documents.first().iterations == 4  # three readings, and one more as the blurred one counts otherwise


def test_resume_from_the_latest_snapshot(spark):
    """What is stored goes on as if it had never stopped; a legacy row without lines is checked against its groups, a damaged one is an error."""
    ev = lambda i, t, text, at=0: (f"0197a1b2-c3d4-7e5f-8a6b-0c1d2e3f4a{i:02x}", t, '{"OcrVariant":{"variant":"original","page":1,"line_index":%d}}' % at, '{"OcrLine":{"text":"%s","confidence":1.0}}' % text)  # noqa: E731, UP031
    rows = [ev(1, 10, "total 12"), ev(2, 11, "total 12"), ev(3, 12, "other words", 1), ev(4, 30, "total 19"), ev(5, 31, "other words", 1)]
    df = spark.createDataFrame(rows, "id string, timestamp long, source string, payload string").withColumn("document_id", uuid5(NAMESPACE_URL, F.lit("event://" + rows[0][0])))
    positions, documents = replay.replay(df.where("timestamp <= 12"), "document_id")
    documents = documents.withColumns({"document_id": F.col("group_id"), "iterations": F.col("iterations").cast("int")})
    state = positions.withColumns({"line": F.col("line_index") + 1, "convergence_bps": F.lit(None).cast("int")})
    stored = snapshots.snapshots(documents, state, F.lit("s1"), F.lit("1970-01-01 00:00:12").cast("timestamp"))
    legacy = stored.withColumn("lines", F.filter("lines", lambda x: F.lit(False)))
    whole = replay.replay(df, "document_id")[1].first()
    for rows_ in (stored, legacy):
        got = replay.from_latest(df, rows_).first()
        assert (got.mode, got.applied_events, got.iterations, got.source, got.convergence_bps) == ("checkpoint+tail", 2, 5, whole.source, whole.convergence_bps)
    assert replay.from_latest(df, None).first()["mode"] == "genesis" and replay.from_latest(df, stored.limit(0)).first()["mode"] == "genesis"
    with pytest.raises(ValueError, match="content_hash_mismatch"):
        replay.from_latest(df, legacy.withColumn("content_hash", F.lit("0197a1b2-c3d4-7e5f-8a6b-0c1d2e3f4a00")))


def brute_jaro_winkler(a, b):
    """By the definition, on lists of code points."""
    reach, used, hits = max(0, max(len(a), len(b)) // 2 - 1), set(), []
    for i, c in enumerate(a):
        j = next((j for j, d in enumerate(b) if c == d and abs(i - j) <= reach and j not in used), None)
        if j is not None:
            used.add(j)
            hits.append(c)
    if not hits:
        return 0.0
    crossed = sum(x != b[j] for x, j in zip(hits, sorted(used), strict=True)) // 2
    sim = (len(hits) / len(a) + len(hits) / len(b) + (len(hits) - crossed) / len(hits)) / 3
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return sim + 0.1 * same * (1 - sim) if sim > 0.7 else sim


KEYS = [("perché la qualità è nota", "perche la qualita e nota"), ("größe der tür", "grösse der tur"), ("лестница у стены", "лестиица у степы"), ("деталь kt-57294", "детапь kt-57294"), ("total 12.5", "total 125"), ("éa", "aé")]


def keyed_lines(spark, tmp_path, rows):
    spark.createDataFrame(rows, "line_id long, group_id string, source string, variant string, page int, line int, text string, confidence float").write.parquet(str(tmp_path / "ocr_lines.parquet"))
    return str(tmp_path)


def test_jw_pairs_in_every_script(spark, tmp_path):
    rows = [(2 * i + k, "g", "s", v, 1, i, pair[k], 1.0) for i, pair in enumerate(KEYS) for k, v in enumerate(("original", "high_contrast"))]
    got = {frozenset((r.a, r.b)): r.similarity for r in core.jw_pairs(spark, keyed_lines(spark, tmp_path, rows)).collect()}
    assert got == {frozenset(p): pytest.approx(brute_jaro_winkler(*p), abs=1e-6) for p in KEYS}
    assert len(got) == len(KEYS)


def test_pairs_of_all_variants(spark, tmp_path):
    said = {"original": "non total 12", "high_contrast": "total 12", "rotated": "total 13"}
    rows = [(i, "g", "s", v, 1, 1, t, 1.0) for i, (v, t) in enumerate(said.items())] + [(10, "g", "s", "rotated", 1, 1, "Total 13", 1.0), (11, "g", "s", "rotated", 1, 1, "total 1З", 1.0), (12, "g", "s", "rotated", 1, 2, "alone", 1.0)]
    rows += [(20, "h", "s", "original", 1, 1, "total 13", 1.0), (21, "h", "s", "rotated", 1, 1, "total 12", 1.0), (22, "h", "s", None, 1, 1, None, 1.0)]
    d = keyed_lines(spark, tmp_path, rows)
    keys = ["non total 12", "total 12", "total 13", "total 1з"]
    want = {(a, b) for a in keys for b in keys if a < b}
    for query in (core.jw_pairs, core.semantic_veto_pairs):
        got = [(r.a, r.b) for r in query(spark, d).collect()]
        assert set(got) == want and len(got) == len(want)
    vetoes = {(r.a, r.b): (r.veto, r.same_script) for r in core.semantic_veto_pairs(spark, d).collect()}
    assert vetoes["total 12", "total 13"][0] == "numeric" and vetoes["non total 12", "total 13"][0] == "negation" and not vetoes["total 13", "total 1з"][1]


def test_pipeline_takes_every_reading(spark, tmp_path):
    """A second scan of a variant votes too; a repeated delivery doesn't, however its id is spelled."""
    uid = "0197a1b2-c3d4-7e5f-8a6b-0c1d2e3f4a5{}"
    rows = [(uid.format("a"), "s", "original", 1, "2026-01-01", "total 12"), (uid.format("b"), "s", "original", 2, "2026-01-02", "total 12"), (uid.format("c"), "s", "rotated", 3, "2026-01-03", "zeta 99")]
    rows += [("{" + uid.format("c").upper() + "}", "s", "rotated", 3, "2026-01-03", "alpha 11"), (uid.format("C"), "s", "rotated", 4, "2026-01-04", "zeta 99"), (uid.format("d"), "s", "rotated", 4, "2026-01-04", None)]
    for name, given in (("a", rows), ("b", [(i.lower() if "{" in i else "{" + i + "}", *rest) for i, *rest in rows])):
        df = spark.createDataFrame(given, "observation_id string, source string, variant string, batch_no int, arrived_at string, raw_text string").withColumn("arrived_at", F.col("arrived_at").cast("timestamp_ntz"))
        df.write.parquet(str(tmp_path / name / "raw_observations.parquet"))
    got = [core.pipeline_snapshots(spark, str(tmp_path / name)).collect() for name in ("a", "b")]
    assert got[0] == got[1] and [(r.iterations, r.n_lines) for r in got[0]] == [(3, 1)]
    twice = spark.createDataFrame([("s", "original", "a", "total 12"), ("s", "original", "b", "total 12"), ("s", "rotated", "c", "total 13")], "source string, variant string, reading string, text string")
    made = pipeline.process(twice, F.lit("2026-01-01").cast("timestamp"))
    p = made.reduced.first()
    assert p.winner == "total 12" and [c["count"] for c in p.clusters] == [2, 1]
    assert sorted(r.variant for r in made.raw_observations.collect()) == ["original", "original", "rotated"] and made.raw_observations.select("observation_id").distinct().count() == 3


def test_many_clusters_are_not_all_compared(monkeypatch):
    """A position with many clusters compares a text with few of them, with the outcome of comparing it with all in order."""
    rng = random.Random(5)
    texts_ = ["".join(rng.choice("abcdefghij 0123456789") for _ in range(rng.randrange(8, 40))) for _ in range(300)]
    votes = [t if rng.random() < 0.3 else t[:3] + rng.choice("xyz") + t[4:] for t in rng.choices(texts_, k=900)]
    clusters: list = []
    for v in votes:
        c = next((c for c in clusters if similarity.jaro_winkler(min(c), v) >= plurality.THRESHOLD), None)
        if c is None:
            clusters.append(c := [])
        c.append(v)
        clusters.sort(key=lambda c: (-len(c), plurality.best_of(c)))
    calls = []
    monkeypatch.setattr(plurality, "_alike", lambda a, b: calls.append(1) or similarity.jaro_winkler(a, b))
    groups = plurality.Groups()
    for v in votes:
        groups.insert(v)
    assert [sorted(c) for c in clusters] == [[t for t, n in c for _ in range(n)] for c in groups.members()]
    assert len(clusters) > 200 and len(calls) < 20 * len(votes)


def test_replay_parses_an_event_once(spark, tmp_path):
    spark.createDataFrame([event(1, 1, 1, 0, "x")], EV).write.parquet(str(tmp_path / "e"))
    df = spark.read.parquet(str(tmp_path / "e"))
    for made in replay.replay(df, "document_id"):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(StructField(OcrVariant") == plan.count("from_json(StructField(OcrLine") == plan.count("lower(") == 1
