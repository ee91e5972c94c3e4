import itertools
import json
import random
from datetime import datetime, timedelta

from tessella.operators import drift

SCHEMA = "record_id bigint, file_id bigint, file_name string, track string, written_at timestamp_ntz, received_at timestamp_ntz, header string, state string"
T0 = datetime(2014, 1, 1)


def table(spark, headers, track="a", first=0):
    rows = [(first + i, first + i, f"f{i}", track, T0 + timedelta(hours=i), T0 + timedelta(hours=i), h if h is None or isinstance(h, str) else json.dumps(h), "x") for i, h in enumerate(headers)]
    return spark.createDataFrame(rows, SCHEMA)


def found(df):
    return {(r.file_id, r.field_name, r.change_kind) for r in drift.changes(df).collect()}


def test_every_kind_of_change(spark):
    headers = [
        {"n_neurons": 100, "fps": 20, "calcium_key": "Calcium", "flag": True, "names": ["a", "b"]},
        {"unit_count": 104, "fps": 20, "calcium_key": "Calcium", "flag": True, "names": ["b", "a"]},  # renamed without a like name
        '{"unit_count": 104, "fps": 2',  # cut off
        {"unit_count": "104", "fps": None, "ca_key": "Calcium", "flag": True, "names": ["a"]},  # retyped and renamed
        {"unit_count": "104", "fps": "20", "ca_key": "Calcium", "flag": True, "note": "dust"},  # a type known before null; removed, added
        None,
        "[1]",
        {"unit_count": "99", "fps": "20", "ca_key": None, "flag": 1, "note": "dust"},
    ]
    assert found(table(spark, headers)) == {
        (1, "unit_count", "renamed"), (3, "unit_count", "retyped"), (3, "ca_key", "renamed"), (4, "fps", "retyped"), (4, "names", "removed"), (4, "note", "added"), (7, "flag", "retyped"),
    }


def test_tracks_repeats_and_partitions(spark):
    a = table(spark, [{"x": i} if i < 40 else {"y_x": i} for i in range(80)])
    b = table(spark, [{"z": "s"}, {"z": 1}], "b", 100)
    late = a.withColumn("record_id", a.record_id + 1000).withColumn("received_at", a.received_at + __import__("pyspark.sql.functions").sql.functions.expr("interval 9 days"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = found(a.unionByName(late).unionByName(b).repartition(6))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == {(40, "y_x", "renamed"), (101, "z", "retyped")}


def test_a_track_over_many_partitions_is_as_in_one(spark):
    def header(i):
        h = {"n_neurons": [1, 1000, 7][i % 3] if i < 60 else 10 + i % 3} if i < 150 else {"qty": 500 + i % 3}
        text = f"word{i}" if i < 60 else "steady"
        return h | ({"remark": text} if i < 100 else {"zz": "quite other"} if i > 170 else {"note": text})

    t = table(spark, [header(i) for i in range(240)])
    state, want = None, set()
    for i in range(240):
        state, changed = drift.step(state, json.loads(json.dumps(header(i))))
        want |= {(i, c[0], c[1]) for c in changed}
    assert {(150, "qty", "renamed"), (171, "zz", "renamed")} <= want
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert found(t.repartition(8)) == want
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_matching_is_the_best(spark):
    rng = random.Random(3)
    for _ in range(200):
        r, c = rng.randint(1, 4), rng.randint(1, 4)
        gain = [[rng.choice([0, rng.random()]) for _ in range(c)] for _ in range(r)]
        got = drift.assign(gain)
        assert len({i for i, _ in got}) == len(got) == len({j for _, j in got})
        n = max(r, c)
        best = max(sum(gain[i][p[i]] if i < r and p[i] < c else 0 for i in range(n)) for p in itertools.permutations(range(n)))
        assert abs(sum(gain[i][j] for i, j in got) - best) < 1e-9


def test_unified_table(spark):
    t = drift.unified(table(spark, [{"n_neurons": 100, "names": ["a", "b"]}, {"nNeurons": 101, "names": "a;b"}, {"nNeurons": "102.0", "names": {"0": "b"}}])).toPandas().sort_values("file_id")
    assert t["nNeurons"].tolist() == [100.0, 101.0, 102.0]
    assert [list(x) for x in t["names"]] == [["a", "b"], ["a", "b"], ["b"]]


def test_empty(spark):
    assert drift.changes(table(spark, [])).count() == 0
    assert drift.unified(table(spark, [None])).count() == 0
