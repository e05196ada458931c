"""Sinks, images and settings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenfold.config import read_file, resolve
from evenfold.operators import image
from evenfold.schema import EVENTS
from evenfold.sources import store
from evenfold.sources import text as texts


def test_jsonl(spark, tmp_path):
    path = str(tmp_path / "events.jsonl")
    assert store.read_jsonl(spark, path, EVENTS).count() == 0
    (tmp_path / "events.jsonl").write_text('{"id":"a","timestamp":5}\n\n{"id":"b","timestamp":7}\n')
    got = store.read_jsonl(spark, path, EVENTS)
    assert got.count() == 2 and [r.id for r in store.events_after(got, 5).collect()] == ["b"]
    (tmp_path / "events.jsonl").write_text('{"id":"a"\n')
    with pytest.raises(Exception):
        store.read_jsonl(spark, path, EVENTS).collect()
    store.append_jsonl(spark.createDataFrame([("x", 1)], "id string, timestamp bigint"), str(tmp_path / "out"))
    store.append_jsonl(spark.createDataFrame([("y", 2)], "id string, timestamp bigint"), str(tmp_path / "out"))
    assert store.read_jsonl(spark, str(tmp_path / "out"), EVENTS).count() == 2


def test_replace_and_ignore(spark):
    old = spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], "k string, v int, seq int")
    new = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 4, 1), ("c", 5, 2)], "k string, v int, seq int")
    assert {(r.k, r.v) for r in store.replace_into(old, new, ["k"], ["seq"]).collect()} == {("a", 1), ("b", 3), ("c", 5)}
    assert {(r.k, r.v) for r in store.ignore_into(old, new, ["k"], ["seq"]).collect()} == {("a", 1), ("b", 1), ("c", 4)}
    assert store.latest(new, None, ["seq", "v"]).first().v == 5 and store.latest(new.limit(0), None, ["seq"]).count() == 0


def test_otsu(spark):
    half = np.repeat(np.array([50, 200], np.uint8), 5000).reshape(100, 100)
    assert image.otsu_of(np.bincount(half.ravel(), minlength=256)) == 50
    assert image.otsu_of(np.zeros(256)) == 128 and image.otsu_of(np.bincount(np.full(10, 200), minlength=256)) == 128
    rng = np.random.default_rng(1)
    grays = {str(i): rng.integers(0, 256, 500).astype(np.uint8) for i in range(4)} | {"flat": np.full(9, 7, np.uint8)}
    rows = [(k, int(v), int(n)) for k, g in grays.items() for v, n in enumerate(np.bincount(g, minlength=256)) if n]
    got = {r.image_id: r.threshold for r in image.otsu_table(spark.createDataFrame(rows, "image_id string, level int, n bigint")).collect()}
    assert got == {k: image.otsu_of(np.bincount(g, minlength=256)) for k, g in grays.items()}


def test_images(spark):
    gray = np.repeat(np.array([50, 200], np.uint8), 50).reshape(10, 10)
    df = spark.createDataFrame([("a", 10, 10, bytearray(gray.tobytes())), ("broken", 5, 5, bytearray(b"x")), ("empty", 0, 0, bytearray())], image.IMAGES)
    got = {(r.image_id, r.variant): r for r in image.variants(df).collect()}
    assert set(k for k, _ in got) == {"a", "empty"}
    assert got["a", "high_contrast"].threshold == 50 and set(got["a", "high_contrast"].pixels) == {0, 255}
    assert (got["a", "rotated"].roi_width, got["a", "rotated"].resize_factor) == (6, pytest.approx(0.6))
    assert bytes(got["a", "original"].pixels) == gray.tobytes()
    roi = F.struct(F.lit(8).alias("x"), F.lit(0).alias("y"), F.lit(5).alias("width"), F.lit(10).alias("height"), F.lit("signature").alias("kind"), F.struct(F.lit(4).alias("w"), F.lit(5).alias("h")).alias("resize")).alias("roi")
    r = image.regions(df.where("image_id = 'a'").select("*", roi)).first()
    assert (r.name, r.roi_width, r.width, r.height, r.resize_factor) == ("signature_8_0", 2, 4, 5, 2.0)
    assert np.allclose(image.resize(np.full((7, 7), 90, np.uint8), 3, 11), 90)


def test_provider(spark):
    df = spark.createDataFrame([("a", "original", bytearray(b"hi"))], "source string, variant string, content binary")
    assert texts.read_images(df, provider=lambda b, lang, v: f"{b.decode()} {lang} {v}").first().text == "hi ita original"


def test_settings(tmp_path):
    assert resolve(cwd=str(tmp_path), env={}).profile.source == "default"
    (tmp_path / "evenfold.yaml").write_text("profile: Strict\nlang: 'deu'  # note\n")
    c = resolve(cwd=str(tmp_path), env={})
    assert c.profile.value.kind == "strict" and c.lang.value == "deu" and c.lang.source.startswith("file:")
    c = resolve(cwd=str(tmp_path), env={"EVENFOLD_PROFILE": "legacy"})
    assert c.profile.value.kind == "legacy_import" and c.profile.source == "env:EVENFOLD_PROFILE"
    assert resolve("carbo", cwd=str(tmp_path), env={"EVENFOLD_PROFILE": "legacy"}).profile.source == "cli"
    with pytest.raises(ValueError):
        resolve("unknown", cwd=str(tmp_path), env={})
    assert "min_confidence" in c.summary()


@pytest.mark.parametrize("text,want", [
    ("profile: strict\nlang: deu # note\n", {"profile": "strict", "lang": "deu"}), ("# head\n---\nprofile: 'strict'\nlang: \"a#b\"  # x\n", {"profile": "strict", "lang": "a#b"}), ("other:\n  profile: strict\n  lang: x\nlang: a#b\n", {"lang": "a#b"}),
    ("lang: 'it''s'\nprofile:\n", {"lang": "it's"}), ("", {}), ("lang: ita+eng\n", {"lang": "ita+eng"}),
])
def test_settings_file(tmp_path, text, want):
    (tmp_path / "f.yaml").write_text(text)
    assert read_file(tmp_path / "f.yaml") == want


def test_settings_file_of_another_form(tmp_path):
    (tmp_path / "f.yaml").write_text("just words\n")
    with pytest.raises(ValueError):
        read_file(tmp_path / "f.yaml")


def test_image_files(spark, tmp_path):
    gray = np.arange(60, dtype=np.uint8).reshape(6, 10)
    (tmp_path / "a.png").write_bytes(image.png(gray))
    (tmp_path / "b.png").write_bytes(b"no image")
    got = image.read_gray(spark, str(tmp_path)).collect()
    assert [(r.width, r.height, bytes(r.pixels)) for r in got] == [(10, 6, gray.tobytes())]


def test_store_is_opened_once(spark, tmp_path):
    """Opening makes the tables, opening again keeps their rows, a table of another form is refused."""
    root = str(tmp_path / "store")
    made = store.Store(spark, root)
    assert all(made.read(t).count() == 0 for t in store.TABLES) and made.latest_snapshots().count() == 0
    rows = spark.createDataFrame([("s1", "d", 1), ("s2", "d", 2), ("s3", "e", 1)], "snapshot_id string, document_id string, day int").withColumn("created_at", F.timestamp_seconds(F.col("day") * 86400))
    for c in made.read("snapshots").schema:
        if c.name not in rows.columns:
            rows = rows.withColumn(c.name, F.lit(None).cast(c.dataType))
    made.append("snapshots", rows)
    again = store.Store(spark, root)
    assert {r.snapshot_id for r in again.latest_snapshots().collect()} == {"s2", "s3"} and again.latest_snapshots("d").first().snapshot_id == "s2"
    spark.createDataFrame([(1,)], "x int").write.parquet(str(tmp_path / "other/snapshots"))
    with pytest.raises(ValueError, match="lacks"):
        store.Store(spark, str(tmp_path / "other"))


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    """Readings to a store, then events replayed from its snapshots."""
    from evenfold import __main__ as command
    from evenfold import session

    monkeypatch.setattr(session, "local_session", lambda *a: spark)
    spark.createDataFrame([("a.png", "original", "total 12\nzeta"), ("a.png", "rotated", "total 12\nzeta")], "source string, variant string, text string").write.parquet(str(tmp_path / "r"))
    assert command.main(["process", str(tmp_path / "r"), str(tmp_path / "root")]) == 0
    doc = store.Store(spark, str(tmp_path / "root/store")).latest_snapshots().first().document_id
    event = ("0197a1b2-c3d4-7e5f-8a6b-0c1d2e3f4a01", 1, 4_000_000_000, '{"OcrVariant":{"variant":"original","page":1,"line_index":0}}', '{"OcrLine":{"text":"total 12","confidence":1.0}}', 1.0, doc)
    store.append_jsonl(spark.createDataFrame([event], "id string, schema_version int, timestamp bigint, source string, payload string, confidence float, document_id string"), str(tmp_path / "root/events"))
    assert command.main(["replay", str(tmp_path / "root"), "--document", doc]) == 0
    assert "checkpoint+tail" in capsys.readouterr().out
    assert command.main(["show-config"]) == 0 and "profile" in capsys.readouterr().out
