"""Kernels and column functions against literals worked out by hand."""

import uuid

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evenfold.functions import scoring, text
from evenfold.functions.ids import NAMESPACE_OID, NAMESPACE_URL, plain_uuid, uuid5
from evenfold.functions.similarity import jaro_winkler


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("raw,want", [
    ("0197A1B2-C3D4-7E5F-8A6B-0C1D2E3F4A5B", "0197a1b2-c3d4-7e5f-8a6b-0c1d2e3f4a5b"),
    ("{0197a1b2-c3d4-7e5f-8a6b-0c1d2e3f4a5b}", "0197a1b2-c3d4-7e5f-8a6b-0c1d2e3f4a5b"),
    ("urn:uuid:0197a1b2-c3d4-7e5f-8a6b-0c1d2e3f4a5b", "0197a1b2-c3d4-7e5f-8a6b-0c1d2e3f4a5b"),
    (" 0197a1b2c3d47e5f8a6b0c1d2e3f4a5b\n", "0197a1b2-c3d4-7e5f-8a6b-0c1d2e3f4a5b"),
    (" not-a-uuid ", "not-a-uuid"), ("", ""), (None, None),
])
def test_plain_uuid(spark, raw, want):
    assert one(spark, raw, plain_uuid) == want


def test_uuid5(spark):
    names = ["image://original.png", "", "straße", "日本"]
    got = spark.createDataFrame([(n,) for n in names], "x string").select("x", uuid5(NAMESPACE_URL, F.col("x")).alias("u"), uuid5(NAMESPACE_OID, F.col("x")).alias("o")).collect()
    for r in got:
        assert r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, r.x)) and r.o == str(uuid.uuid5(uuid.NAMESPACE_OID, r.x))
    assert one(spark, None, lambda c: uuid5(NAMESPACE_URL, c)) is None


@pytest.mark.parametrize("fn,raw,want", [
    (text.decimal_comma, "1,2,3", "1.2.3"), (text.decimal_comma, "a,1 ,2 3,x", "a,1 ,2 3,x"),
    (text.canonical, " Café 45,20 ", "Café 45.20"),
    (text.collapse, " a \t\n b\u000bc ", "a b\u000bc"),
    (text.display, "A​B\u0085C\u000bD  é", "ABCD é"),
    (text.vote_key, " TOTAL­  45,20 ", "total 45.20"),
    (text.plain, " 45,20 € Größe_x ", "4520 größex"), (text.plain, "café!", "cafe"),
    (text.display, None, None), (text.vote_key, "", ""),
])
def test_normalization(spark, fn, raw, want):
    assert one(spark, raw, fn) == want


def test_traits(spark):
    assert one(spark, "a 30. and .30 or 1.2.3", text.numeric_tokens) == ["30.", ".30", "1.2.3"]
    assert one(spark, "già non pagato", text.negated) and not one(spark, "nonna", text.negated)
    pairs = spark.createDataFrame([("non pagato", "pagato"), ("id 1", "id 2"), ("id", "id 2"), ("a", "b")], "a string, b string")
    assert [r[0] for r in pairs.select(text.veto(F.col("a"), F.col("b"))).collect()] == ["negation", "numeric", None, None]
    assert [r[0] for r in pairs.select(text.differs_in_numbers(F.col("a"), F.col("b"))).collect()] == [False, True, False, False]


def test_jaro_winkler():
    assert jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert jaro_winkler("dixon", "dicksonx") == pytest.approx(0.813333, abs=1e-6)
    assert jaro_winkler("", "") == 1.0 and jaro_winkler("", "a") == 0.0 and jaro_winkler("abc", "xyz") == 0.0
    assert jaro_winkler("line one", "line two") >= 0.90 - 1e-12
    assert jaro_winkler("éa", "ea") > 0


@given(st.text(max_size=12), st.text(max_size=12))
def test_jaro_winkler_bounds(a, b):
    assert 0.0 <= jaro_winkler(a, b) <= 1.0 and jaro_winkler(a, a) == 1.0


def test_weights_and_status(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),), (-1.0,), (2.0,), (0.5,)], "c float")
    assert [r[0] for r in rows.select(scoring.weight(F.col("c"))).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.5]
    parts = spark.createDataFrame([(1.0, 3.0), (1.0, 0.0), (5.0, 4.0), (1.0, 16.0)], "a float, b float")
    assert [r[0] for r in parts.select(scoring.bps(F.col("a"), F.col("b"))).collect()] == [3333, 0, 10000, 625]
    docs = spark.createDataFrame([(0, 9999, 0), (1, 9000, 1000), (1, 9000, 1001), (1, 4999, 0)], "p int, c int, a int")
    assert [r[0] for r in docs.select(scoring.status(F.col("p"), F.col("c"), F.col("a"))).collect()] == ["Failed", "Converged", "Ambiguous", "Failed"]


def test_invalid_observations(spark):
    rows = [("Converged", 0.9, None, None, None), ("Converged", 0.9, "High", None, "converged_with_reason"), ("Failed", 0.1, None, None, "reason_missing"), ("Failed", 1.5, None, "x", "confidence_out_of_range"), ("Failed", None, None, "x", None)]
    df = spark.createDataFrame(rows, "s string, c float, v string, r string, want string")
    got = df.select("want", scoring.invalid(F.col("s"), F.col("c"), F.col("v"), F.col("r")).alias("got")).collect()
    assert all(r.want == r.got for r in got)
