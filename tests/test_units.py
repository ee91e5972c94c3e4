import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.unit_text import PERIODS, circle_scores
from tessella.operators.units import in_radians, recorded_units, step_sums

TEXTS = [
    ("360,0 °", "gaze_angle", "deg"), ("2π rad", "headdirection", "rad"), ("2*pi", "phase", "rad"), ("6 400 mil", "bearing", "mil"), ("Grad (Winkel, 360)", "angle", "deg"),
    ("400 Grad", "angle", "gon"), ("24h clock", "time_of_day", "hour"), ("1 turn", "wheel_phase", "turn"), ("-180..180", "angle", "deg"), ("gradians", "angle", "gon"),
]


@pytest.mark.parametrize("text, field, code", TEXTS)
def test_text(text, field, code):
    s = dict(zip(PERIODS, circle_scores(text, field)))
    assert max(s, key=s.get) == code and sorted(s.values())[-1] > sorted(s.values())[-2]


@pytest.mark.parametrize("text", [None, "", "mm", "cm/s", "1/s", "a.u.", "x" * 5000])
def test_text_that_says_nothing(text):
    assert set(circle_scores(text, "speed")) == {0.0}


def test_readings_decide(spark):
    rng = np.random.default_rng(2)
    kinds = {1: ("deg", 360, False), 2: ("rad", 2 * math.pi, True), 3: ("gon", 400, True), 4: ("turn", 1, False), 5: ("hour", 24, False), 6: ("mil", 6400, True)}
    rows, labels = [], []
    for k, (_, p, signed) in kinds.items():
        x = (np.cumsum(rng.uniform(0.01, 0.06, 60)) % 1) * p
        x = np.where(signed & (x > p / 2), x - p, x)
        rows += [(k, t * 7, float(v)) for t, v in enumerate(x)] + [(k, 14, float(x[2])), (k, 21, None), (k, 22, float("nan"))]
        labels.append((k, "gaze_angle", "2π rad", 2 * math.pi, False, datetime(2014, 1, 1)))  # wrong for most
    rows += [(7, t, float(v)) for t, v in enumerate(rng.uniform(0, 1, 60).cumsum())] + [(8, t, float(t % 2)) for t in range(60)] + [(None, 1, 1.0), (9, 1, None)]
    labels += [(7, "speed", "cm/s", None, None, datetime(2014, 1, 1)), (10, None, None, None, None, None)]
    f = spark.createDataFrame(rows, "series_id bigint, t bigint, feat_value double")
    s = spark.createDataFrame(labels, "series_id bigint, feature string, period_text string, circular_period double, is_circular boolean, noted_at timestamp_ntz")
    got = {r.series_id: r.unit_code for r in recorded_units(s, f.repartition(5)).collect()}
    assert got == {k: v[0] for k, v in kinds.items()}
    rad = in_radians(s, f).toPandas()
    assert rad.radians.max() <= 2 * math.pi and len(rad[rad.series_id == 1]) == 61  # 60 readings and the one at t = 22
    assert recorded_units(s, f.limit(0)).count() == 0


def test_labels_decide_where_the_readings_leave_several_units(spark):
    # the steps across are shorter than the usual ones in degrees as in gon, so both close the circle
    turn = [5.0, 105.0, 205.0, 305.0, 355.0] * 8
    texts = {1: ("360 °", "deg"), 2: ("400 gon", "gon"), 3: ("gradians", "gon"), 4: ("-180..180 deg", "deg"), 5: ("kilogon 0.4", "gon")}
    f = spark.createDataFrame([(k, t, v) for k in texts for t, v in enumerate(turn)], "series_id bigint, t bigint, feat_value double")
    s = spark.createDataFrame([(k, "angle", x, None, True, datetime(2014, 1, 1)) for k, (x, _) in texts.items()], "series_id bigint, feature string, period_text string, circular_period double, is_circular boolean, noted_at timestamp_ntz")
    got = {r.series_id: r.unit_code for r in recorded_units(s, f).collect()}
    assert {k: got[k] for k in (1, 2, 3, 4)} == {k: texts[k][1] for k in (1, 2, 3, 4)}
    fine = spark.createDataFrame([(1, t, float((t * 7) % 360)) for t in range(120)], "series_id bigint, t bigint, feat_value double")
    assert recorded_units(s.withColumn("period_text", F.lit("400 gon")), fine).first().unit_code == "deg"  # where they don't, readings hold


def test_a_series_over_many_batches_is_as_in_one(spark):
    f = spark.createDataFrame([(1, t, float((t * 7) % 360)) for t in range(900)], "series_id bigint, t bigint, feat_value double")
    one = step_sums(f.repartition(1)).collect()
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        many = step_sums(f.repartition(3)).collect()
        assert len(many) == len(one) == 1 and many[0].n == one[0].n == 900
        assert all(np.allclose(many[0][c], one[0][c]) for c in ("lo", "hi", "wraps", "gap", "steps", "moves"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
