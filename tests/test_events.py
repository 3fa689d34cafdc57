import pytest
from pyspark.sql import functions as F

from rowloom.operators import contracts, events, generate
from rowloom.streaming.runner import run_available

SPAN = 86_400_000_000
START = "2024-03-01 00:00:00"


def times(spark, pattern, n=100, seed=42):
    df = events.event_times(generate.row_index(spark, n), "row_idx", n, pattern, START, SPAN, seed)
    return df.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "row_idx").collect()


@pytest.mark.parametrize("pattern", ["steady", "burst", "seasonal", "growth"])
def test_times_stay_in_the_window_and_repeat(spark, pattern):
    first = spark.sql(f"SELECT unix_micros(CAST(TIMESTAMP_NTZ '{START}' AS TIMESTAMP)) AS t").first().t
    got = times(spark, pattern)
    assert got == times(spark, pattern) and got != times(spark, pattern, seed=43)
    assert all(first <= r.t <= first + SPAN for r in got)
    assert times(spark, pattern, 0) == []


def test_patterns_have_their_shape(spark):
    first = min(r.t for r in times(spark, "steady", 2000))
    late = lambda p: sum(r.t > first + 0.9 * SPAN for r in times(spark, p, 2000)) / 2000
    assert late("burst") > 0.33 and late("steady") < 0.14
    rising = sorted(times(spark, "growth", 500), key=lambda r: r.row_idx)
    assert [r.t for r in rising] == sorted(r.t for r in rising)


def test_events_are_numbered_in_time_order(spark):
    made = events.generate_events(generate.row_index(spark, 500), "row_idx", 500, "iot_telemetry", "seasonal", START, SPAN, 1)
    rows = made.orderBy("event_no").collect()
    assert [r.event_no for r in rows] == list(range(500)) and rows[7].event_id == "evt_00000007"
    assert [r.ts for r in rows] == sorted(r.ts for r in rows)
    assert {r.entity_id for r in rows} <= {f"entity_{i}" for i in range(1, 51)}


def test_late_arrivals(spark):
    made = events.event_times(generate.row_index(spark, 2000), "row_idx", 2000, "steady", START, SPAN, 1)
    rows = events.late_arrivals(made, "row_idx", 0.25, 1).collect()
    late = [r for r in rows if r.late_arrival]
    assert 0.2 < len(late) / 2000 < 0.3
    assert all(60 <= (r.ts - r.event_ts_original).total_seconds() <= 3600 for r in late)
    assert all(r.event_ts_original is None for r in rows if not r.late_arrival)


@pytest.mark.parametrize("mode", ["ordered", "shuffled", "windowed"])
def test_replay_is_a_permutation(spark, mode):
    rows = events.replay_order(generate.row_index(spark, 100), "row_idx", 100, mode, 3).collect()
    assert sorted(r.arrival_seq for r in rows) == list(range(100))
    moved = sum(r.arrival_seq != r.row_idx for r in rows)
    assert (moved == 0) == (mode == "ordered")
    if mode == "windowed":
        assert all(r.arrival_seq // 20 == r.row_idx // 20 for r in rows)


def test_link_report(spark):
    made = spark.createDataFrame([("e1",), ("e2",), ("e3",), (None,)], "event_id string")
    notes = spark.createDataFrame(
        [("e1", "low", "a"), ("e1", "low", "a"), ("zz", None, "b"), ("", "high", None), (None, "high", "a")],
        "linked_event_id string, severity string, event_type string",
    )
    row = events.link_totals(made, notes).first()
    assert (row.total_events, row.linked_event_count, row.orphan_link_count, row.coverage_ratio) == (4, 1, 1, 0.25)
    assert [r.linked_event_id for r in events.orphan_links(made, notes).collect()] == ["zz"]
    got = {(r.dimension, r.label): r.notes for r in events.link_breakdown(notes).collect()}
    assert got[("severity", "unknown")] == 1 and got[("event_type", "event")] == 1


def test_contract(spark):
    contract = contracts.Contract("User", ("id", "name"), {"id": "integer", "name": "string"})
    cases = {
        '{"id":1,"name":"x"}': None,
        '{"id":1}': "missing required property: name",
        '{"other":1}': "missing required property: id; missing required property: name",
        '{"id":"1","name":"x"}': "property id is not integer",
        '{"id":1,"name":"x"} trailing': "Invalid JSON",
        '{"id":1,"name":"x"},{"id":2,"name":"y"}': "Invalid JSON",
        "[]": "Expected object",
        "": "Invalid JSON",
        "{": "Invalid JSON",
    }
    df = spark.createDataFrame([(c,) for c in [*cases, None]], "r string")
    got = {r.r: (r.passed, r.reason) for r in contracts.check_records(df, "r", contract).collect()}
    assert got == {**{c: (reason is None, reason) for c, reason in cases.items()}, None: (False, "Invalid JSON")}


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    def add(first):
        spark.range(first, first + 5).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
        return sorted(r.id for r in run_available(stream, "test", str(tmp_path / "query")).collect())

    assert add(0) == list(range(5))
    assert add(5) == list(range(10))


def test_stream_equals_batch(spark, tmp_path):
    df = spark.range(300).withColumn("ts", F.timestamp_seconds(F.col("id") + 1_700_000_000))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    late = run_available(events.late_arrivals(stream, "id", 0.3, 1), "test")
    assert sorted(late.collect()) == sorted(events.late_arrivals(df, "id", 0.3, 1).collect())
