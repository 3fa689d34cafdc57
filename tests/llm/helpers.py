"""Small tables for the tests of this folder."""

import duckdb

FOLDER = "/root/testdata/sf0.001"

# Names that collide with those the operators make themselves.
CLASHING = "score double, copy long, mix_order long, n_lines int, n_deleted int, label int, token string, _gone string, _items int, chunk int"


def documents(spark, rows, clashing=False):
    """Rows of ``doc_id, text`` or ``doc_id, text, lang, source`` as the documents table."""
    full = [(r[0], r[1], *(r[2:] or ("en", "web")), None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    if clashing:
        df = df.selectExpr("*", *[f"CAST(NULL AS {kind}) AS {name}" for name, kind in (x.strip().split(" ") for x in CLASHING.split(","))])
    return df


def duck(docs_rows, sql):
    """A SQL twin on ``doc_id, text, lang, source`` rows."""
    connection = duckdb.connect()
    connection.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    full = [(r[0], r[1], *(r[2:] or ("en", "web")), len(r[1])) for r in docs_rows]
    if full:
        connection.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", full)
    return connection.sql(sql).fetchall()


def collected(df):
    return [tuple(r) for r in df.collect()]
