import pytest
from pyspark.sql import functions as F

from rowloom.sources import readers, writers


def sample(spark):
    return spark.createDataFrame([(1, "a", 1.5), (2, None, None), (3, 'q"uo,te', 2.0)], "id bigint, s string, v double")


def test_csv_is_all_text(spark, tmp_path):
    path = writers.write_csv(sample(spark), str(tmp_path / "t.csv"))
    got = readers.scan_csv(spark, path).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("1", "a", "1.5"), ("2", "", ""), ("3", 'q"uo,te', "2.0")]


def test_json_round_trips(spark, tmp_path):
    df = sample(spark)
    array = writers.write_json_array(df.repartition(3), str(tmp_path / "a.json"))
    lines = writers.write_jsonl(df, str(tmp_path / "l.jsonl"))
    expected = sorted(map(str, df.collect()))
    assert sorted(map(str, readers.scan_json(spark, array, df.schema).collect())) == expected
    assert sorted(map(str, readers.scan_jsonl(spark, lines, df.schema).collect())) == expected


def test_dataset_folder(spark, tmp_path):
    df = sample(spark)
    root = str(tmp_path / "data")
    writers.write_csv(df, f"{root}/one.csv")
    writers.write_parquet(df, f"{root}/two.parquet")
    writers.write_parquet(df.filter("id > 9"), f"{root}/empty.parquet")
    (tmp_path / "data" / "ignored.txt").write_text("x")
    assert set(readers.list_tables(spark, root)) == {"one", "two", "empty"}
    loaded = readers.load_dataset(spark, root)
    assert {k: v.count() for k, v in loaded.items()} == {"one": 3, "two": 3}


def test_layer_lookup_prefers_top(spark, tmp_path):
    df = sample(spark)
    root = str(tmp_path / "layered")
    writers.write_parquet(df, f"{root}/gold/t.parquet")
    writers.write_parquet(df.limit(1), f"{root}/silver/t.parquet")
    writers.write_parquet(df.limit(2), f"{root}/u.parquet")
    writers.write_parquet(df, f"{root}/silver/u.parquet")
    found = readers.load_layered(spark, root)
    assert {k: v.count() for k, v in found.items()} == {"t": 1, "u": 2}


def test_insert_text(spark):
    df = spark.createDataFrame([(1, "it's \\", True, None)], "a int, b string, c boolean, d double")
    assert writers.insert_statements(df, "t").first().value == (
        "INSERT INTO t (a, b, c, d) VALUES (1, 'it''s \\\\', TRUE, NULL);"
    )


@pytest.mark.parametrize("kind", ["parquet", "jsonl", "csv"])
def test_layers_are_written_in_order(spark, tmp_path, kind):
    df = spark.createDataFrame([("1", " a  b ", 0), ("1", "c", 1), ("2", " ", 2)], "k string, v string, n int")
    paths = writers.write_layers(df, str(tmp_path / "out"), "t", "k", "n", kind)
    read = {layer: readers.scan(spark, p, kind).orderBy("n").collect() for layer, p in paths.items()}
    assert [len(read[layer]) for layer in ("bronze", "silver", "gold")] == [3, 2, 2]
    assert [r.v or None for r in read["gold"]] == ["a b", None]


def test_seeds_unite_columns(spark, tmp_path):
    one, two = sample(spark).select("id", "s"), sample(spark).select("id", "v")
    paths = writers.write_seeds({"t": [one, two], "none": [one.filter("id > 9")]}, str(tmp_path / "seeds"))
    assert set(paths) == {"t"}
    got = readers.scan_csv(spark, paths["t"])
    assert got.columns == ["id", "s", "v"] and got.count() == 6


def test_jdbc_options():
    options = writers.jdbc_options("jdbc:x", "t", {"user": "u"})
    assert options == {"url": "jdbc:x", "dbtable": "t", "batchsize": "1000", "user": "u"}


def test_micros_survive_json(spark, tmp_path):
    df = spark.range(1).select(F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00.123456'").alias("t"))
    path = writers.write_jsonl(df, str(tmp_path / "t.jsonl"))
    assert readers.scan_jsonl(spark, path, df.schema).first() == df.first()
