"""Change tags, messiness, anomalies, drift and layers on the given tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import rng
from rowloom.functions.rng import salts
from rowloom.operators import anomalies, change_tags, drift, flow, layers, messiness
from rowloom.operators.privacy import mask_for
from rowloom.operators.profile import row_counts
from rowloom.operators.selection import exact_share
from rowloom.suite import duck
from rowloom.suite.registry import TABLES, query, table, tables

SEED = 42
KEY = "o_orderkey"


def _exact_sql(relation: str, ratio: float, tag: str, at_least: int = 1) -> str:
    """Keys of the exactly chosen share."""
    return (
        f"SELECT {KEY} FROM (SELECT {KEY}, row_number() OVER (ORDER BY {duck.draw(SEED, tag, KEY)}, {KEY}) AS r "
        f"FROM {relation}) WHERE r <= greatest({at_least}, floor((SELECT count(*) FROM {relation}) * {ratio}::DOUBLE))"
    )


# Change tags

_CREATED = f"TIMESTAMP '2024-01-01' + to_seconds({SEED} + 17 * o_orderkey)"
_CHANGED = f"o_orderkey IN ({_exact_sql('orders', 0.2, 'orders.change', 0)})"


def _changed(orders: DataFrame):
    return exact_share(orders, 0.2, SEED, "orders.change", KEY, at_least=0)


def incremental_sql(changed: str) -> str:
    return f"""SELECT *, {_CREATED} AS created_at,
    {_CREATED} + CASE WHEN {changed} THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS updated_at,
    'batch_42' AS batch_id FROM orders"""


@query("tag_incremental", incremental_sql(_CHANGED))
def tag_incremental(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return change_tags.tag_incremental(orders, KEY, _changed(orders), SEED)


def cdc_sql(changed: str) -> str:
    roll = duck.randint(SEED, "orders.cdc.op", KEY, 0, 99)
    return f"""WITH op AS (SELECT *, CASE WHEN NOT ({changed}) OR {roll} < 70 THEN 'INSERT'
                              WHEN {roll} < 90 THEN 'UPDATE' ELSE 'DELETE' END AS op_type FROM orders)
    SELECT *, {_CREATED} AS created_at, 'b7' AS batch_id,
    CASE WHEN op_type = 'UPDATE' THEN {_CREATED} + INTERVAL 2 HOUR ELSE {_CREATED} END AS updated_at,
    CASE WHEN op_type = 'DELETE' THEN {_CREATED} + INTERVAL 3 HOUR END AS deleted_at FROM op"""


@query("tag_cdc", cdc_sql(_CHANGED))
def tag_cdc(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return change_tags.tag_cdc(orders, KEY, _changed(orders), SEED, "orders", "b7")


@query(
    "cdc_op_check",
    """SELECT count(*) AS rows_checked, count(*) FILTER (event_type NOT IN ('view', 'click')) AS invalid_ops,
    count(*) FILTER (event_type NOT IN ('view', 'click')) = 0 AS cdc_op_type_valid FROM events""",
)
def cdc_op_check(spark: SparkSession, folder: str) -> DataFrame:
    op = F.when(F.col("event_type") == "view", "INSERT").when(F.col("event_type") == "click", "DELETE").otherwise(
        F.col("event_type")
    )
    return change_tags.invalid_operations(table(spark, folder, "events").select(op.alias("op_type")))


# Messiness, on raw orders: every column but the key is text

RAW = """SELECT o_orderkey, o_custkey::VARCHAR AS o_custkey,
    CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'active' ELSE 'pending' END AS o_orderstatus,
    o_totalprice::VARCHAR AS o_totalprice, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate,
    o_orderpriority FROM orders"""
NUMBERS = ("o_custkey", "o_totalprice")
WORDS = ("o_orderstatus", "o_orderdate", "o_orderpriority")


def raw_orders(spark: SparkSession, folder: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "O", "active").otherwise(
        "pending"
    )
    orders = table(spark, folder, "orders").withColumn("o_orderstatus", status)
    return messiness.to_raw(orders, keep=[KEY])


def _u(tag: str) -> str:
    return duck.uniform(SEED, tag, KEY)


def _cell(c: str) -> str:
    flip = salts(0, f"orders.{c}")[0]
    mixed = f"((xor({duck.draw(SEED, 'orders.mess.cells', KEY)}, {flip}) * {rng.MIX}) & {rng.LOW32})"
    return f"xor({mixed}, {mixed} >> 16)"


def _cell_text(c: str) -> str:
    return messiness.cell_draw_text("orders", c, messiness.row_draw_text(SEED, "orders", KEY))


def _hit(c: str, chance: float) -> str:
    return f"({_cell(c)}) < {int(chance * 4294967296)}"


def _coin(c: str) -> str:
    return f"(({_cell(c)}) & 1) = 0"


def ws_sql(c: str) -> str:
    return (
        f"CASE WHEN length({c}) > 0 AND {_hit(c, 0.5)} THEN CASE WHEN {_coin(c)} "
        f"THEN '  ' || {c} ELSE {c} || chr(9) || ' ' END ELSE {c} END"
    )


def casing_sql(c: str) -> str:
    return (
        f"CASE WHEN length({c}) > 2 AND {_hit(c, 0.4)} THEN CASE WHEN {_coin(c)} "
        f"THEN lower({c}) ELSE upper({c}) END ELSE {c} END"
    )


def date_sql(c: str) -> str:
    day = f"split_part({c}, 'T', 1)"
    y, m, d = (f"split_part({day}, '-', {i})" for i in (1, 2, 3))
    return (
        f"CASE WHEN regexp_matches({c}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND {_hit(c, 0.5)} "
        f"THEN CASE WHEN {_coin(c)} THEN {m} || '/' || {d} || '/' || {y} "
        f"ELSE {m} || '-' || {d} || '-' || {y} END ELSE {c} END"
    )


def enum_sql(c: str) -> str:
    return (
        f"CASE WHEN {_hit(c, 0.5)} THEN CASE lower({c}) WHEN 'active' THEN 'Active' WHEN 'pending' "
        f"THEN 'PENDING' WHEN 'canceled' THEN 'cancelled' WHEN 'paid' THEN 'Paid' ELSE {c} END ELSE {c} END"
    )


def _fault(name: str, mutate, sql, columns: Sequence[str]) -> None:
    """Register one fault applied to all rows."""
    chosen = ", ".join(f"{sql(c)} AS {c}" for c in columns)

    @query(name, f"WITH raw AS ({RAW}) SELECT o_orderkey, {chosen} FROM raw")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return raw_orders(spark, folder).select(
            KEY, *[F.expr(mutate(c, _cell_text(c))).alias(c) for c in columns]
        )


_fault("mess_whitespace", messiness.whitespace, ws_sql, WORDS)
_fault("mess_casing", messiness.casing, casing_sql, WORDS)
_fault("mess_date_format", messiness.date_format, date_sql, ("o_orderdate", "o_orderpriority"))
_fault("mess_enum", messiness.enum_spelling, enum_sql, ("o_orderstatus", "o_orderpriority"))


@query(
    "mess_num_to_str",
    "SELECT o_orderkey, o_totalprice::VARCHAR AS o_totalprice, "
    f"{_hit('o_totalprice', 0.5)} AS o_totalprice_as_text FROM orders",
)
def mess_num_to_str(spark: SparkSession, folder: str) -> DataFrame:
    raw = raw_orders(spark, folder)
    hit = F.expr(messiness.number_hit("o_totalprice", _cell_text("o_totalprice")))
    return raw.select(KEY, "o_totalprice", hit.alias("o_totalprice_as_text"))


def messy_sql(profile: str, relation: str, touched: str) -> str:
    roll = _u("orders.mess.kind")
    bands = " ".join(f"WHEN {roll} < {end} THEN '{name}'" for name, end in messiness.BANDS[profile])
    chaotic = profile == "chaotic"
    columns = ", ".join(
        f"CASE fault WHEN 'whitespace' THEN {ws_sql(c)} WHEN 'casing' THEN {casing_sql(c)} "
        f"WHEN 'dates' THEN {date_sql(c)} " + (f"WHEN 'enums' THEN {enum_sql(c)} " if chaotic else "") + f"ELSE {c} END AS {c}"
        for c in WORDS
    )
    quoted = " + ".join(f"CASE WHEN fault = 'numbers' AND {_hit(c, 0.5)} THEN 1 ELSE 0 END" for c in NUMBERS)
    extra = f", ({quoted})::INTEGER AS as_text_columns" if chaotic else ""
    return (
        f"SELECT o_orderkey, o_custkey, o_totalprice, {columns}{extra} FROM "
        f"(SELECT *, CASE WHEN {touched} THEN CASE {bands} END END AS fault FROM {relation})"
    )


MESSY = "WITH raw AS (" + RAW + "), messy AS (" + messy_sql(
    "chaotic", "raw", f"o_orderkey IN ({_exact_sql('raw', 0.4, 'orders.mess.row')})"
) + ")"


def messy_orders(spark: SparkSession, folder: str) -> DataFrame:
    raw = raw_orders(spark, folder)
    touched = exact_share(raw, messiness.ROW_SHARE["chaotic"], SEED, "orders.mess.row", KEY)
    return messiness.apply_messiness(raw, KEY, "chaotic", SEED, "orders", touched, NUMBERS)


@query("apply_messiness", MESSY + " SELECT * FROM messy")
def apply_messiness(spark: SparkSession, folder: str) -> DataFrame:
    return messy_orders(spark, folder)


@query(
    "apply_messiness_realistic",
    f"WITH raw AS ({RAW}) " + messy_sql("realistic", "raw", f"{_u('orders.mess.row')} < 0.15"),
)
def apply_messiness_realistic(spark: SparkSession, folder: str) -> DataFrame:
    return messiness.apply_messiness(
        raw_orders(spark, folder), KEY, "realistic", SEED, "orders", number_columns=NUMBERS
    )


# Anomalies, on raw orders

CELLS = ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
BROKEN_SQL = "chr(0) || chr(255) || chr(254) || ' broken ' || chr(0)"


def anomaly_sql(relation: str, hit: str, kinds: Sequence[str]) -> str:
    kind = duck.choose(SEED, "orders.anomaly.kind", KEY, kinds)
    anyone = duck.randint(SEED, "orders.anomaly.column", KEY, 0, len(CELLS) - 1)
    enum = duck.randint(SEED, "orders.anomaly.enum", KEY, 0, len(CELLS) - 1)
    text = f"(({duck.draw(SEED, 'orders.anomaly.text', KEY)} * {len(CELLS)}) >> 32)"
    columns = ", ".join(
        f"CASE WHEN kind = 'null_field' AND any_at = {i} THEN NULL WHEN kind = 'invalid_enum' AND enum_at = {i} "
        f"THEN '__INVALID__' WHEN kind = 'empty_string' AND text_at = {i} THEN '' "
        f"WHEN kind = 'malformed_string' AND text_at = {i} THEN {BROKEN_SQL} ELSE {c} END AS {c}"
        for i, c in enumerate(CELLS)
    )
    return (
        f"SELECT o_orderkey, {columns} FROM (SELECT *, CASE WHEN {hit} THEN {kind} END AS kind, "
        f"{anyone} AS any_at, {enum} AS enum_at, {text} AS text_at FROM {relation})"
    )


def _anomaly(name: str, kind: str) -> None:
    hit = f"{_u('orders.anomaly.row')} < 0.25"

    @query(name, f"WITH raw AS ({RAW}) {anomaly_sql('raw', hit, [kind])}")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return anomalies.inject_anomalies(
            raw_orders(spark, folder), KEY, 0.25, SEED, "orders", [kind], skip=[KEY]
        )


_anomaly("anom_null", anomalies.NULL_FIELD)
_anomaly("anom_empty", anomalies.EMPTY_STRING)
_anomaly("anom_invalid_enum", anomalies.INVALID_ENUM)
_anomaly("anom_malformed", anomalies.MALFORMED_STRING)


@query(
    "anom_duplicate",
    f"SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE {_u('orders.duplicate')} < 0.1",
)
def anom_duplicate(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return anomalies.append_duplicates(orders, rng.below(0.1, SEED, "orders.duplicate", KEY))


INJECTED = anomaly_sql(
    "raw", f"o_orderkey IN ({_exact_sql('raw', 0.05, 'orders.anomaly.row')})", anomalies.DEFAULT_TYPES
)


def injected_orders(spark: SparkSession, folder: str) -> DataFrame:
    raw = raw_orders(spark, folder)
    ratio = anomalies.effective_ratio(0.02, "chaotic")
    hit = exact_share(raw, ratio, SEED, "orders.anomaly.row", KEY)
    return anomalies.inject_anomalies(raw, KEY, ratio, SEED, "orders", hit=hit, skip=[KEY])


@query("inject_anomalies", f"WITH raw AS ({RAW}) {INJECTED}")
def inject_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    return injected_orders(spark, folder)


# Drift

LOGICAL = {"int": "integer", "bigint": "bigint", "string": "string", "double": "float", "timestamp_ntz": "timestamp"}
DRIFT_SEED = 207


def _events(profile: str = "aggressive") -> list[drift.DriftEvent]:
    declared = {t: [(c, LOGICAL[k]) for c, k in TABLES[t].items()] for t in ("customer", "orders")}
    return drift.plan_drift(declared, profile, DRIFT_SEED)


@query("drift_add", "SELECT *, NULL::VARCHAR AS _drift_207_1 FROM customer")
def drift_add(spark: SparkSession, folder: str) -> DataFrame:
    return drift.add_column(table(spark, folder, "customer"), "_drift_207_1")


@query("drift_rename", "SELECT * RENAME (c_mktsegment AS c_mktsegment_renamed) FROM customer")
def drift_rename(spark: SparkSession, folder: str) -> DataFrame:
    return drift.rename_column(table(spark, folder, "customer"), "c_mktsegment", "c_mktsegment_renamed")


@query(
    "drift_type",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag || l_linenumber AS flag,
        l_suppkey::VARCHAR AS supplier FROM lineitem)
    SELECT l_orderkey, l_linenumber::VARCHAR AS l_linenumber, l_partkey, l_suppkey, NULL::BIGINT AS flag,
        flag AS flag_unparsed, supplier::BIGINT AS supplier, NULL::VARCHAR AS supplier_unparsed FROM t""",
)
def drift_type(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("flag"),
        F.col("l_suppkey").cast("string").alias("supplier"),
    )
    for name, to in (("l_linenumber", "string"), ("flag", "integer"), ("supplier", "integer")):
        lines = drift.change_type(lines, name, to)
    return lines


@query(
    "apply_drift",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice AS o_totalprice_renamed, o_orderdate,
       NULL::BIGINT AS o_orderpriority, o_orderpriority AS o_orderpriority_unparsed FROM orders""",
)
def apply_drift(spark: SparkSession, folder: str) -> DataFrame:
    return drift.apply_drift(table(spark, folder, "orders"), "orders", _events())


@query(
    "drift_summary",
    """WITH log(event_type, t) AS (VALUES ('nullability_change', 'customer'), ('add_column', 'customer'),
          ('change_type', 'orders'), ('rename_column', 'orders')),
       sizes AS (SELECT 'customer' AS t, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders)
       SELECT event_type, count(*) AS events, sum(n)::BIGINT AS affected_rows FROM log JOIN sizes USING (t)
       GROUP BY event_type""",
)
def drift_summary(spark: SparkSession, folder: str) -> DataFrame:
    log = drift.drift_log(spark, _events())
    return drift.drift_summary(log, row_counts(tables(spark, folder, "customer", "orders")))


# Layers

# Code points of all whitespace.
SPACES = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028,
    0x2029, 0x202F, 0x205F, 0x3000,
)
BLANKS = " || ".join(f"chr({c})" for c in SPACES)
RUN = r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def clean_sql(relation: str, columns: Sequence[str]) -> str:
    cleaned = ", ".join(f"nullif(trim({c}, {BLANKS}), '') AS {c}" for c in columns)
    return f"SELECT * REPLACE ({cleaned}) FROM {relation}"


def gold_sql(relation: str, columns: Sequence[str]) -> str:
    collapsed = ", ".join(f"regexp_replace(trim({c}, {BLANKS}), '{RUN}', ' ', 'g') AS {c}" for c in columns)
    return f"SELECT * REPLACE ({collapsed}) FROM {relation}"


@query("silver_clean", f"{MESSY}, damaged AS ({anomaly_sql('messy', 'true', ['empty_string'])}) "
       + clean_sql("damaged", CELLS))
def silver_clean(spark: SparkSession, folder: str) -> DataFrame:
    messy = messy_orders(spark, folder).drop("as_text_columns")
    emptied = anomalies.plant(messy, KEY, F.lit(True), [anomalies.EMPTY_STRING], SEED, "orders", skip=[KEY])
    return layers.silver_clean(emptied, KEY)


# First order of each customer; customers of the third status count as unknown
FIRST_ORDERS = """SELECT * FROM (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS o_custkey, o_orderkey,
    o_orderstatus, o_totalprice FROM orders)
    QUALIFY o_custkey IS NULL OR row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1"""


def orders_by_customer(orders: DataFrame) -> DataFrame:
    known = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey"))
    return orders.select(known.alias("o_custkey"), "o_orderkey", "o_orderstatus", "o_totalprice")


@query("silver_dedup", FIRST_ORDERS)
def silver_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return layers.keep_first(orders_by_customer(table(spark, folder, "orders")), "o_custkey", "o_orderkey")


@query("gold_normalize", gold_sql("documents", ("text", "lang", "source")))
def gold_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return layers.gold_normalize(table(spark, folder, "documents"))


BRONZE = f"""{MESSY}, copies AS (SELECT * REPLACE (o_orderkey AS o_orderkey), 1 AS copy FROM messy
        WHERE {_u('orders.duplicate')} < 0.1),
    bronze AS (SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
        o_orderpriority, o_orderkey * 2 AS arrival FROM messy
        UNION ALL SELECT o_orderkey::VARCHAR, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
        o_orderkey * 2 + 1 FROM copies),
    silver AS (SELECT * FROM ({clean_sql('bronze', CELLS)})
        QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY arrival) = 1),
    gold AS ({gold_sql('silver', CELLS)})"""


def bronze_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Messy orders with repeated rows; ``arrival`` is the order in which they came."""
    messy = messy_orders(spark, folder).drop("as_text_columns")
    copied = anomalies.with_copies(messy, rng.below(0.1, SEED, "orders.duplicate", KEY), "copy")
    arrival = F.col(KEY) * 2 + F.col("copy")
    return copied.withColumns({"arrival": arrival, KEY: F.col(KEY).cast("string")}).drop("copy")


@query("to_layer", f"{BRONZE} SELECT * FROM gold")
def to_layer(spark: SparkSession, folder: str) -> DataFrame:
    return layers.to_layer(bronze_orders(spark, folder), "gold", KEY, "arrival")


@query(
    "silver_typed",
    f"""WITH raw AS ({RAW}), damaged AS ({INJECTED}), cleaned AS ({clean_sql('damaged', CELLS)}),
    t AS (SELECT o_orderkey, try_cast(o_custkey AS BIGINT) AS o_custkey, o_orderstatus,
        try_cast(o_totalprice AS DOUBLE) AS o_totalprice, try_cast(o_orderdate AS TIMESTAMP) AS o_orderdate,
        o_orderpriority, o_custkey AS ck, o_totalprice AS tp, o_orderdate AS od FROM cleaned)
    SELECT * EXCLUDE (ck, tp, od), ((ck IS NOT NULL AND o_custkey IS NULL)::INTEGER
        + (tp IS NOT NULL AND o_totalprice IS NULL)::INTEGER + (od IS NOT NULL AND o_orderdate IS NULL)::INTEGER)::INTEGER
        AS cast_failures FROM t""",
)
def silver_typed(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = layers.silver_clean(injected_orders(spark, folder), KEY)
    return layers.typed(
        cleaned, {"o_custkey": "bigint", "o_totalprice": "double", "o_orderdate": "timestamp_ntz"}
    )


@query(
    "layer_deltas",
    f"""{BRONZE} SELECT greatest(0, (SELECT count(*) FROM bronze) - (SELECT count(*) FROM silver))
        AS bronze_to_silver_removed,
    greatest(0, (SELECT count(*) FROM silver) - (SELECT count(*) FROM gold)) AS silver_to_gold_removed""",
)
def layer_deltas(spark: SparkSession, folder: str) -> DataFrame:
    bronze = bronze_orders(spark, folder)
    silver = layers.to_layer(bronze, "silver", KEY, "arrival")
    gold = layers.gold_normalize(silver)
    return layers.layer_deltas({"bronze": {"orders": bronze}, "silver": {"orders": silver}, "gold": {"orders": gold}})


# Everything in a row: source to bronze, silver, gold and a masked copy

FLOW = flow.FlowSettings(SEED, anomalies=anomalies.effective_ratio(0.02, "chaotic"))


@query(
    "run_pipeline",
    f"""WITH raw AS ({RAW}), damaged AS ({INJECTED}), n AS (SELECT count(DISTINCT o_orderkey) AS keys FROM damaged)
    SELECT 'orders' AS table_name, 'source' AS stage, count(*) AS row_count FROM orders
    UNION ALL SELECT 'orders', 'bronze', count(*) FROM damaged
    UNION ALL SELECT 'orders', stage, keys FROM n, (VALUES ('silver'), ('gold'), ('shared')) s(stage)""",
)
def run_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    orders = {"orders": table(spark, folder, "orders")}
    return flow.run_flow(orders, {"orders": KEY}, FLOW, {"orders": {"o_orderpriority": "name"}}).row_counts()


# The same with cells: drift of this seed renames the key of orders and a number of customers

ROWS_FLOW = flow.FlowSettings(136, anomalies=anomalies.effective_ratio(0.02, "chaotic"))
SENSITIVE = {"orders": {"o_orderpriority": "name"}, "customer": {"c_name": "name"}}
RENAMED = {"o_orderkey": "o_orderkey_renamed", "c_acctbal": "c_acctbal_renamed"}
FLOW_STAGES = ("source", "bronze", "silver", "gold", "shared")


def flow_sql(name: str, key: str) -> str:
    """Rows of every stage of one table: ``table_name, stage, row_key, cells``."""
    seed, types = ROWS_FLOW.seed, TABLES[name]
    source = [c for c in types if c != key]
    data = [RENAMED.get(c, c) for c in source]
    cells = [*data, "created_at", "batch_id", "op_type", "updated_at", "deleted_at"]
    numbers = [RENAMED.get(c, c) for c in source if types[c] in ("int", "bigint", "double")]
    row_draw = duck.draw(seed, f"{name}.mess.cells", "k")

    def iso(c: str) -> str:
        return f"strftime({c}, '%Y-%m-%dT%H:%M:%S')"

    def joined(columns: Sequence[str]) -> str:
        return "concat_ws('|', " + ", ".join(f"coalesce({c}, '-')" for c in columns) + ")"

    def messy(c: str) -> str:
        flip = salts(0, f"{name}.{c}")[0]
        mixed = f"((xor({row_draw}, {flip}) * {rng.MIX}) & {rng.LOW32})"
        cell = f"xor({mixed}, {mixed} >> 16)"
        coin, half = f"(({cell}) & 1) = 0", f"({cell}) < {1 << 31}"
        y, m, d = (f"split_part(split_part({c}, 'T', 1), '-', {i})" for i in (1, 2, 3))
        return f"""CASE
            WHEN fault = 'whitespace' AND length({c}) > 0 AND {half}
            THEN CASE WHEN {coin} THEN '  ' || {c} ELSE {c} || chr(9) || ' ' END
            WHEN fault = 'casing' AND length({c}) > 2 AND ({cell}) < {int(0.4 * 4294967296)}
            THEN CASE WHEN {coin} THEN lower({c}) ELSE upper({c}) END
            WHEN fault = 'dates' AND {half} AND regexp_matches({c}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(T|$)')
            THEN {m} || CASE WHEN {coin} THEN '/' ELSE '-' END || {d} || CASE WHEN {coin} THEN '/' ELSE '-' END || {y}
            ELSE {c} END AS {c}"""

    def text(c: str) -> str:
        return iso(c) if types[c] == "timestamp_ntz" else f"{c}::VARCHAR"

    roll, kind = duck.randint(seed, f"{name}.cdc.op", "k", 0, 99), duck.choose(seed, f"{name}.anomaly.kind", "k", anomalies.DEFAULT_TYPES)
    bands = " ".join(
        f"WHEN {duck.uniform(seed, f'{name}.mess.kind', 'k')} < {end} THEN '{fault}'" for fault, end in messiness.BANDS["realistic"]
    )
    untouched = [*numbers, "batch_id", "op_type"]
    shaken = ", ".join(c if c in untouched else messy(c) for c in cells)
    filled = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN {i} END" for i, c in enumerate(cells))
    last = len(cells) - 1
    damaged = ", ".join(
        f"""CASE WHEN kind = 'null_field' AND any_at = {i} THEN NULL WHEN kind = 'invalid_enum' AND enum_at = {i} THEN '__INVALID__'
            WHEN kind = 'empty_string' AND text_at = {i} THEN '' WHEN kind = 'malformed_string' AND text_at = {i} THEN {BROKEN_SQL}
            ELSE {c} END AS {c}"""
        for i, c in enumerate(cells)
    )
    masked = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN {duck.quoted(mask_for(m))} END AS {c}" for c, m in SENSITIVE[name].items())
    return f"""
    tagged AS (SELECT *, TIMESTAMP '2024-01-01' + to_seconds({seed} + 17 * k) AS made,
        CASE WHEN {duck.uniform(seed, f'{name}.cdc.row', 'k')} >= {ROWS_FLOW.changed} OR {roll} < 70 THEN 'INSERT'
        WHEN {roll} < 90 THEN 'UPDATE' ELSE 'DELETE' END AS op_type FROM (SELECT *, {key} AS k FROM {name})),
    raw AS (SELECT k, {", ".join(f"{text(c)} AS {d}" for c, d in zip(source, data))}, {iso('made')} AS created_at,
        'batch_{seed}' AS batch_id, op_type,
        {iso("made + CASE WHEN op_type = 'UPDATE' THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END")} AS updated_at,
        CASE WHEN op_type = 'DELETE' THEN {iso('made + INTERVAL 3 HOUR')} END AS deleted_at FROM tagged),
    messy AS (SELECT k, {shaken} FROM (SELECT *, CASE WHEN {duck.uniform(seed, f'{name}.mess.row', 'k')} < 0.15
        THEN CASE {bands} END END AS fault FROM raw)),
    hit AS (SELECT k FROM (SELECT k, row_number() OVER (ORDER BY {duck.draw(seed, f'{name}.anomaly.row', 'k')}, k) AS r FROM raw)
        WHERE r <= greatest(1, floor((SELECT count(*) FROM raw) * {ROWS_FLOW.anomalies}::DOUBLE))),
    placed AS (SELECT *, filled[1 + (({duck.draw(seed, f'{name}.anomaly.text', 'k')} * len(filled)) >> 32)] AS text_at FROM (
        SELECT *, CASE WHEN k IN (SELECT k FROM hit) THEN {kind} END AS kind,
        {duck.randint(seed, f'{name}.anomaly.column', 'k', 0, last)} AS any_at,
        {duck.randint(seed, f'{name}.anomaly.enum', 'k', 0, last)} AS enum_at,
        list_filter([{filled}], lambda x: x IS NOT NULL) AS filled FROM messy)),
    bronze AS (SELECT k, {damaged} FROM placed),
    silver AS ({clean_sql('bronze', cells)}),
    gold AS ({gold_sql('silver', cells)}),
    shared AS (SELECT * REPLACE ({masked}) FROM gold)
    SELECT '{name}' AS table_name, 'source' AS stage, {key} AS row_key, {joined([text(c) for c in source])} AS cells FROM {name}
    """ + " ".join(
        f"UNION ALL SELECT '{name}', '{stage}', k, {joined(cells)} FROM {stage}" for stage in FLOW_STAGES[1:]
    )


@query(
    "run_pipeline_rows",
    f"""SELECT * FROM (WITH {flow_sql('orders', 'o_orderkey')})
    UNION ALL SELECT * FROM (WITH {flow_sql('customer', 'c_custkey')})""",
)
def run_pipeline_rows(spark: SparkSession, folder: str) -> DataFrame:
    keys = {"orders": KEY, "customer": "c_custkey"}
    return flow.run_flow(tables(spark, folder, *keys), keys, ROWS_FLOW, SENSITIVE).rows(keys)
