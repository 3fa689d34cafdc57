"""Streams against their batch twins: several micro-batches, shuffled arrival, restarts, hot keys, late rows."""

import random

import pytest
from pyspark.sql import functions as F

from rowloom.operators import events, layers, rules
from rowloom.plans import joins
from rowloom.plans.spec import BusinessRule
from rowloom.streaming import operators as S
from rowloom.streaming.runner import BATCH, run_available, run_batches, run_observed, run_updates

START = 1_700_000_000


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def arriving(spark, path, schema, one_by_one=True):
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", 1) if one_by_one else reader).parquet(str(path))


RULES = [
    BusinessRule("low", "range", "t", fields=["x"], params={"min": 10}), BusinessRule("odd", "custom", "t", expression="x % 2 = 1"),
    BusinessRule("never", "range", "t", fields=["x"], params={"min": -10**6}),
]


def test_rule_counts_over_batches_and_a_restart(spark, tmp_path):
    schema, draw = "id int, x int", random.Random(1)
    every = []

    def turn(files):
        for _ in range(files):
            rows = [(draw.randrange(99), draw.choice([None, *range(20)])) for _ in range(30)]
            every.extend(rows)
            put(spark, tmp_path / "in", rows, schema)
        counts = S.rule_counts(arriving(spark, tmp_path / "in", schema), "t", RULES)
        return sorted(run_updates(counts, ["table_name", "rule", "kind"], "t", str(tmp_path / "query")).collect())

    for files in (3, 2, 0):
        assert turn(files) == sorted(rules.row_violations(spark.createDataFrame(every, schema), "t", RULES).collect())
    written = spark.read.parquet(str(tmp_path / "query" / "data"))
    assert {r[0] for r in written.select(BATCH).distinct().collect()} == {0, 1, 2, 3, 4}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    """A batch that failed after writing part of its rows writes them again over the first ones."""
    put(spark, tmp_path / "in", [(i,) for i in range(10)], "id int")
    put(spark, tmp_path / "in", [(i,) for i in range(10, 20)], "id int")
    left = {"failures": 1}

    def step(batch):
        return batch.filter("id % 2 = 0")

    def failing(batch):
        if left["failures"] and batch.filter("id >= 10").count():
            left["failures"] -= 1
            raise RuntimeError("lost")
        return step(batch)

    stream = arriving(spark, tmp_path / "in", "id int")
    with pytest.raises(Exception, match="lost"):
        run_batches(stream, failing, "t", str(tmp_path / "query"))
    got = run_batches(arriving(spark, tmp_path / "in", "id int"), failing, "t", str(tmp_path / "query"))
    assert sorted(r.id for r in got.collect()) == list(range(0, 20, 2))


def test_no_rows_at_all(spark, tmp_path):
    put(spark, tmp_path / "in", [], "id int, x int")
    stream = arriving(spark, tmp_path / "in", "id int, x int")
    assert run_batches(stream, lambda b: b, "t").count() == 0


def gaps(rows, gap):
    made, groups = [], {}
    for group, second, value in rows:
        if second is not None:
            groups.setdefault(group, []).append((second, value))
    for group, found in groups.items():
        found.sort(key=lambda x: x[0])
        start = 0
        for i in range(1, len(found) + 1):
            if i == len(found) or found[i][0] - found[i - 1][0] > gap:
                part = found[start:i]
                made.append((part[0][0], part[-1][0] + gap, group, len(part), sum(v for _, v in part)))
                start = i
    return sorted(made, key=str)


def in_seconds(df):
    second = [F.unix_seconds(F.col(c).cast("timestamp")) - START for c in ("session_start", "session_end")]
    return sorted(((a, b, g, n, v) for a, b, g, n, v in df.select(*second, "g", "events", "value_sum").collect()), key=str)


EVENT = "g string, ts timestamp, value double"


def timed(spark, rows):
    return spark.createDataFrame([(g, s, float(v)) for g, s, v in rows], "g string, s long, value double").select(
        "g", F.timestamp_seconds(F.col("s") + START).alias("ts"), "value"
    )


@pytest.mark.parametrize("seed", range(2))
def test_sessions_as_brute_force(spark, seed):
    draw = random.Random(seed)
    rows = [(draw.choice(["hot", "hot", "hot", "a", None]), draw.choice([None, *[draw.randrange(400) for _ in range(9)]]), draw.randrange(9)) for _ in range(90)]
    rows += [("exact", 0, 1), ("exact", 10, 1), ("exact", 21, 1)]
    whole = events.event_sessions(timed(spark, rows), "10 seconds", ["g"], "value", slice_of="15 seconds")
    assert in_seconds(whole) == gaps(rows, 10)
    assert events.event_sessions(timed(spark, []), "10 seconds", ["g"], "value").count() == 0


def test_sessions_that_arrive_late_and_in_parts(spark, tmp_path):
    draw = random.Random(5)
    rows = [(draw.choice("ab"), draw.randrange(0, 2000), draw.randrange(9)) for _ in range(150)]
    # Out of order by up to 300 seconds, in five files; the last one moves the watermark past all sessions.
    order = sorted(rows, key=lambda r: r[1] + draw.randrange(300))
    for part in [*[order[i : i + 30] for i in range(0, 150, 30)], [("end", 9000, 1)]]:
        timed(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = arriving(spark, tmp_path / "in", EVENT)
    got = in_seconds(run_available(S.closed_sessions(stream, "10 seconds", "400 seconds", ["g"], "value"), "t"))
    assert got == gaps(rows, 10)


def test_least_row_in_whatever_order_it_arrives(spark, tmp_path):
    schema = "k long, part string, rank long, ts timestamp, amount double, at timestamp_ntz, tags array<string>"
    draw = random.Random(3)
    rows = [(draw.randrange(20), draw.choice(["x", None]), i, draw.randrange(1000), draw.random()) for i in range(200)]

    def shaped(part):
        df = spark.createDataFrame(part, "k long, part string, rank long, s long, amount double")
        return df.select(
            "k", "part", "rank", F.timestamp_micros((F.col("s") + START) * 1_000_000 + 7).alias("ts"), "amount",
            F.expr("timestamp_ntz'2024-01-01 00:00:00.123456'").alias("at"), F.array("part").alias("tags"),
        )

    draw.shuffle(rows)
    for part in [*[rows[i : i + 40] for i in range(0, 200, 40)], [(99, "end", 0, 9000, 0.0)]]:
        shaped(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = arriving(spark, tmp_path / "in", schema)
    kept = S.keep_least_in_watermark(stream, ["k", "part"], "rank", "ts", "2000 seconds")
    got = run_available(kept, "t")
    keyed = shaped(rows).withColumn("both", F.struct("k", "part"))
    assert got.schema.simpleString() == stream.schema.simpleString()
    assert sorted(got.collect(), key=str) == sorted(layers.keep_first(keyed, "both", "rank").drop("both").collect(), key=str)


def test_least_row_takes_nulls_last(spark, tmp_path):
    schema = "k long, rank double, ts timestamp"
    stamp = "timestamp_seconds({} + 1700000000)"
    for part in ("(1, NULL, 5), (1, 2.5D, 6), (2, NULL, 7)", "(1, 1.5D, 4), (3, 1.0D, NULL)", "(9, 0.0D, 9000)"):
        spark.sql(f"SELECT CAST(k AS long) k, CAST(r AS double) rank, {stamp.format('t')} ts FROM VALUES {part} v(k, r, t)").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    kept = S.keep_least_in_watermark(arriving(spark, tmp_path / "in", schema), ["k"], "rank", "ts", "100 seconds")
    assert sorted((r.k, r.rank) for r in run_available(kept, "t").collect()) == [(1, 1.5), (2, None)]


def settled_in_turn(files, delay):
    """What comes out of files that arrive one by one, as (key, rank, second): late rows dropped, a key settled once the watermark passed it."""
    kept, out, newest, passed = {}, [], None, 0
    for rows in [*files, []]:
        met = set()
        for key, rank, second in rows:
            if second is not None and second <= passed:
                continue
            best, due = kept.get(key, (None, None))
            if best is None or (rank is not None and (best[1] is None or rank < best[1])):
                best = (key, rank, second)
            kept[key] = (best, due if second is None else max(due or 0, second))
            met.add(key)
        out += [kept.pop(k)[0] for k in [k for k, (_, due) in kept.items() if due is not None and due < passed and k not in met]]
        newest = max([newest or 0, *[s for _, _, s in rows if s is not None]])
        passed = max(passed, newest - delay)
    return sorted(out, key=str)


@pytest.mark.parametrize("groups", [1, 5])
def test_keys_that_share_a_state_settle_one_by_one(spark, tmp_path, groups):
    draw = random.Random(groups)
    big = 2**53
    files = [
        [(draw.randrange(9), draw.choice([None, *range(big, big + 50)]), draw.choice([None, *[draw.randrange(300) + 200 * i for _ in range(9)]])) for _ in range(12)]
        for i in range(1, 9)
    ]
    files = [[*f, (100 + i, 0, None), (200 + i, i, 200 * i + 300)] for i, f in enumerate(files)]
    files[0] += [(50, 4, 250), (50, None, 260)]
    files[1] += [(None, None, 480), (None, big + 1, None), (None, big, 450)]
    files[4] += [(50, 9, 1090)]
    for rows in files:
        df = spark.createDataFrame(rows, "k long, rank long, s long").select("k", "rank", F.timestamp_seconds("s").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = arriving(spark, tmp_path / "in", "k long, rank long, ts timestamp")
    got = run_available(S.keep_least_in_watermark(stream, ["k"], "rank", "ts", "250 seconds", groups), "t", str(tmp_path / "query"))
    rows = got.select("k", "rank", F.unix_seconds("ts")).collect()
    assert sorted((tuple(r) for r in rows), key=str) == settled_in_turn(files, 250)
    assert {(50, 4, 250), (50, 9, 1090), (None, big, 450)} < {tuple(r) for r in rows}
    held = spark.read.format("statestore").load(str(tmp_path / "query" / "progress"))
    assert 0 < held.count() <= groups


def test_notes_without_an_event(spark, tmp_path):
    draw = random.Random(2)
    made = [(i, draw.randrange(3000)) for i in range(120)]
    notes = [(f"n{i}", i if i % 3 else i + 1000, s + 50) for i, s in made if i % 2] + [("nothing", None, 10), ("too late", made[2][0], made[2][1] + 900)]
    clock = lambda s: F.timestamp_seconds(F.col(s) + START)
    for part in [made[:60], made[60:], [(5000, 20000)]]:
        spark.createDataFrame(part, "event_id long, s long").select("event_id", clock("s").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    for part in [notes[:20], notes[20:], [("end", 5000, 20001)]]:
        spark.createDataFrame(part, "note string, linked_event_id long, s long").select("note", "linked_event_id", clock("s").alias("note_ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "n"))
    found = S.unlinked_notes(
        arriving(spark, tmp_path / "e", "event_id long, ts timestamp"), arriving(spark, tmp_path / "n", "note string, linked_event_id long, note_ts timestamp"),
        "4000 seconds", "600 SECONDS",
    )
    got = sorted(r.note for r in run_available(found, "t").collect())
    known = dict(made)
    expect = [n for n, link, t in notes if link not in known or not known[link] <= t <= known[link] + 600]
    assert got == sorted(expect) and "nothing" in got and "too late" in got


def test_a_hot_key_on_a_stream(spark, tmp_path, monkeypatch):
    """One key in a third of the rows, and parents that are too many to broadcast."""
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    rows = [(i, 7 if i % 3 == 0 else i % 40) for i in range(600)] + [(600, None)]
    for part in (rows[:300], rows[300:]):
        put(spark, tmp_path / "in", part, "id int, fk int")
    parent = spark.range(0, 40, 2).select(F.col("id").cast("int").alias("pk"))
    stream = arriving(spark, tmp_path / "in", "id int, fk int")
    step = S.split_orphans(stream, "fk", parent, "pk")
    got = run_batches(stream, step, "t")
    assert sorted(r.id for r in got.collect()) == [i for i, k in rows if k is not None and k % 2]
    plan = step(spark.createDataFrame(rows, "id int, fk int"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan


def test_measured_while_running(spark, tmp_path):
    base = spark.range(400).select(F.col("id"), F.timestamp_seconds(F.col("id") * 60 + START).alias("ts"), F.lit("k").alias("g"), F.lit(1.0).alias("value"))
    late = events.late_arrivals(base, "id", 0.3, 1)
    for low, high in ((0, 200), (200, 400), (0, 5)):
        late.filter(F.col("id").between(low, high - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = arriving(spark, tmp_path / "in", late.schema)
    windows = S.closed_windows(S.observed_late(stream, "30 MINUTES"), "1 hour", "1 hour", ["g"], "value")
    _, batches = run_observed(windows, "t")
    again = late.union(late.filter("id < 5"))
    report = events.late_report(again, "1 hour", "30 MINUTES").agg(F.sum("events"), F.sum("late_events"), F.sum("beyond_allowed")).first()
    assert tuple(sum(b.get(n) or 0 for b in batches) for n in ("events", "late_events", "beyond_allowed")) == tuple(report)
    assert sum(b["rows"] for b in batches) == 405 and len([b for b in batches if b["rows"]]) == 3
    assert sum(b["late_dropped"] for b in batches) > 0
