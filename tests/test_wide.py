from datetime import datetime

from tessella.operators import wide

TYPES = {"me": "double", "stage1": "boolean", "n_events": "bigint", "computed_at": "timestamp", "mouse": "string", "a": "string", "b": "string", "c": "string"}
T0, T1 = datetime(2014, 1, 1), datetime(2014, 1, 2)
SCHEMA = "row_id bigint, entity_id bigint, attr_name string, attr_value string, written_at timestamp_ntz, value int, _v int"


def table(spark, rows):
    return spark.createDataFrame([(i, e, a, v, t, 0, 0) for i, (e, a, v, t) in enumerate(rows)], SCHEMA)


def test_latest_readable_value_and_faults(spark):
    rows = table(
        spark,
        [
            (1, " ME ", "0,5", T0), (1, "me", "O.3l", T1), (1, "Stage1", "np.True_", T0), (1, "stage1", "1", T1),
            (2, "me", "np.float64(1e-3)", T0), (2, "n-events", "12.0", T0), (2, "n events", "+12", T1), (2, "mouse", "x ", T0), (2, "mouse", " y", T1),
            (3, "computed at", "2014-02-30 10:00:00", T0), (3, "me", "n/a", T0), (3, "me", None, T1),
            (4, "COMPUTED_AT", "2014-02-03T16:52:43", T0), (4, "n_events", "1.5", T0), (4, "unknown", "1", T0),
            (None, "me", "1", T0), (5, None, "1", T0), (6, "me", "1", T0), (6, "me", "2", T0),
        ],
    )
    w = {r.entity_id: r for r in wide.widen(rows, TYPES).collect()}
    assert set(w) == {1, 2, 3, 4, 6}
    assert w[1].me == 0.5 and w[1].stage1 is True
    assert w[2].me == 0.001 and w[2].n_events == 12 and w[2].mouse == "y"
    assert w[3].me is None and w[3].computed_at is None
    assert w[4].computed_at == datetime(2014, 2, 3, 16, 52, 43) and w[4].n_events is None
    assert w[6].me == 2.0  # a tie in time: the greater row_id
    f = {tuple(r) for r in wide.faults(rows, TYPES).collect()}
    assert f == {(1, "me", "unreadable"), (2, "mouse", "conflict"), (3, "computed_at", "unreadable"), (4, "n_events", "unreadable"), (6, "me", "conflict")}


def test_empty_and_long_values(spark):
    assert wide.widen(table(spark, []), TYPES).count() == 0
    assert wide.faults(table(spark, []), TYPES).count() == 0
    long = "9" * 100_000
    rows = table(spark, [(1, "mouse", long, T0), (1, "n_events", long, T0), (1, "mouse", long, T0)])
    assert wide.widen(rows, TYPES).first().mouse == long
    assert [tuple(r) for r in wide.faults(rows, TYPES).collect()] == [(1, "n_events", "unreadable")]


def test_no_table_is_broadcast_however_small_its_file(spark):
    rows = table(spark, [(e, a, "1", T0) for e in range(50) for a in ("me", "n_events", "mouse", "a", "b", "c")])
    for names in (["me", "n_events"], list(TYPES)):  # one node, and a tree of nodes
        plan = wide.cells(rows, {n: TYPES[n] for n in names})._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan and "Exchange" not in plan
