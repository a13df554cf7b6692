import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from paperloom.functions import display
from paperloom.operators import flows as W
from paperloom.operators import pages as P


def test_focus_and_verdicts(spark):
    rng = np.random.default_rng(0)
    noise, flat = rng.integers(0, 256, (40, 30), dtype=np.uint8), np.full((40, 30), 250, np.uint8)
    rows = [(1, 30, 40, noise.tobytes()), (2, 30, 40, flat.tobytes()), (3, 30, 40, b"x"), (4, None, None, None), (5, 1, 1, b"a")]
    frame = spark.createDataFrame(rows, "page int, width int, height int, gray binary")
    m = frame.select("page", P.image_metrics(F.struct("width", "height", "gray")).alias("m"))
    got = {r.page: r.m for r in m.collect()}
    padded = np.pad(noise.astype(float), 1, mode="reflect")
    kernel = np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]])
    want = np.array([[(padded[i : i + 3, j : j + 3] * kernel).sum() for j in range(30)] for i in range(40)]).var()
    assert abs(got[1].sharpness - round(want, 1)) < 0.1 and got[2].sharpness == 0 and got[3].sharpness is None and got[4].ink is None
    checked = m.select(F.lit(7).alias("doc_id"), "page", P.verdicts(F.col("m"), F.lit(200.0)).alias("checks"))
    found = P.prescan(checked.where("page = 2")).first()
    assert found.verdict == "warn" and found.reasons == ["page 2: sharpness"]  # an empty page isn't blamed for its contrast
    assert P.prescan(checked.where("page = 1")).first().verdict == "pass"
    assert P.focus(rng.integers(0, 256, (300, 2500), dtype=np.uint8)) > 0


def test_image_metrics_query_uses_whole_texts(spark, tmp_path):
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(lo, lo + 40, 9000 + 7))) for lo in (33, 80)]
    texts.append(texts[0][:4096] + "\xe9" * 6400)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in entry.queries()["image_metrics"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        gray = np.frombuffer(t.encode("latin-1"), np.uint8)[: len(t) // 32 * 32].reshape(-1, 32)
        assert abs(got[i].sharpness - P.focus(gray)) < 0.1
        assert np.allclose((got[i].contrast, got[i].brightness, got[i].ink), (gray.std(), gray.mean(), (gray < 200).mean()))


def test_skew(spark):
    angles = spark.createDataFrame([(0.0,), (44.0,), (46.0,), (-45.0,), (-46.0,), (90.0,)], "a double")
    assert [r.x for r in angles.select(P.skew(F.col("a")).alias("x")).collect()] == [0.0, 44.0, -44.0, 45.0, 44.0, 0.0]


def test_detections(spark):
    box = lambda cx, cy, s: dict(cx=cx, cy=cy, w=20.0, h=10.0, score=s)
    rows = [(1, [box(50.0, 50.0, 0.9), box(52.0, 50.0, 0.8), box(5.0, 5.0, 0.6), box(90.0, 90.0, 0.1)], 0.5, 10.0, 0.0, 100, 100), (2, [], 1.0, 0.0, 0.0, 10, 10)]
    frame = spark.createDataFrame(rows, "page int, candidates array<struct<cx:double,cy:double,w:double,h:double,score:double>>, scale double, pad_x double, pad_y double, width int, height int")
    found = [tuple(r) for r in P.detections(frame, ["page"]).collect()]
    assert found == [(1, 60.0, 90.0, 100.0, 100.0, 0.9), (1, 0.0, 0.0, 10.0, 20.0, 0.6)]


def test_flows(spark):
    rows = [(1, 0, "total", "about $1,5", 0.8), (1, 1, "total", "$9", 1.0), (1, 2, "tax", "none", 0.8), (1, 3, "vendor", " A ", 0.7)]
    got = {r.field: (r.value and (r.value.n, r.value.s), r.confidence) for r in W.assembled(spark.createDataFrame(rows, "doc_id int, ord int, cls string, text string, confidence double"), ["total", "tax"]).collect()}
    assert got == {"total": ((15.0, None), 0.8), "tax": (None, 0.4), "vendor": ((None, "A"), 0.7)}
    body = spark.createDataFrame([('{"data": [{"id": "b", "name": "beta", "architecture": {"input_modalities": ["image"]}}, {"id": "a", "name": "Alpha", "architecture": {"input_modalities": ["text", "image"]}}, {"id": "c", "name": "c", "architecture": {"input_modalities": ["text"]}}]}',)], "body string")
    assert [r.id for r in W.image_models(body).collect()] == ["a", "b"]
    odd = spark.range(1).select(W.findings(F.lit("no json")).alias("a"), W.server_events(F.lit("data: 1")).alias("b")).first()
    assert odd.a == [] and odd.b == []


def test_display(spark):
    row = spark.range(1).select(
        display.money(F.lit(1234.5), F.lit("usd")).alias("a"), display.money(F.lit(85.0), F.lit(None).cast("string")).alias("b"), display.percent(F.lit(0.875)).alias("c"),
        display.day(F.lit("2026-05-31T10:00:00Z")).alias("d"), display.day(F.lit("x")).alias("e"), display.is_money(F.lit("Unit_Price")).alias("f"),
        display.scaled(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(5.0)), F.lit(2.0)).alias("g"), display.region_key(F.lit(1), F.array(*(F.lit(x) for x in (1.4, 2.6, 3.0, 4.0)))).alias("h"),
        display.route(F.lit("#/cases/c%201?member=m")).alias("i"), display.match_key(F.lit("# A--b | C-d: $5.00")).alias("j"),
    ).first()
    assert row.a == "$1,234.50" and row.b == "85" and row.c == "88%" and row.d == "May 31, 2026" and row.e == "" and row.f
    assert tuple(row.g) == (2.0, 4.0, 4.0, 6.0) and row.h == "1:1:3:3:4" and (row.i.view, row.i.id, row.i.member) == ("case", "c 1", "m") and row.j == "a b c-d $5.00"
