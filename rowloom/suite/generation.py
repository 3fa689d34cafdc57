"""Generation on the row positions of the given tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import providers
from rowloom.functions.shapes import apply_shape, floor_to
from rowloom.operators import generate
from rowloom.operators.foreign_keys import assign_foreign_key
from rowloom.plans.catalog import union_all
from rowloom.plans.planning import PerParent, RowPlanner
from rowloom.plans.spec import ColumnSpec, DatasetSpec, ForeignKey, Shape, TableSpec, ValueRule
from rowloom.suite import duck
from rowloom.suite.registry import query, table

SEED = 42
KEY = "o_orderkey"


def _positions(spark: SparkSession, folder: str) -> DataFrame:
    """Order keys are the row positions."""
    return table(spark, folder, "orders").select(F.col(KEY).alias("row_idx"))


def _values(name: str, make, oracle: str) -> None:
    """Register a query that generates one value per order."""

    @query(name, f"SELECT {KEY} AS row_idx, {oracle} AS value FROM orders")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _positions(spark, folder).select("row_idx", make("row_idx").alias("value"))


def _rule(name: str, rule: ValueRule, oracle: str) -> None:
    _values(name, lambda index: generate.rule_value(rule, SEED, name, index), oracle)


@query("gen_index", "SELECT unnest(range((SELECT count(*) // 4 FROM orders), "
       "(SELECT count(*) // 4 + count(*) // 2 FROM orders))) AS row_idx")
def gen_index(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").count()
    return generate.row_index(spark, rows, rows // 4, rows // 2)


CHUNKED = TableSpec(
    "chunked",
    [
        ColumnSpec("id", "bigint"),
        ColumnSpec("amount", "integer", rule=ValueRule("range", {"min": 1, "max": 500})),
        ColumnSpec("label", "string", rule=ValueRule("weighted_choice", {"choices": ["a", "b"], "weights": [1, 3]})),
    ],
    ["id"],
)


@query(
    "gen_chunked",
    f"""SELECT {KEY} + {generate.key_base('chunked', SEED)} AS id,
       {duck.randint(SEED, 'chunked.amount', KEY, 1, 500)}::INTEGER AS amount,
       {duck.weighted(SEED, 'chunked.label', KEY, ['a', 'b'], [1, 3])} AS label FROM orders""",
)
def gen_chunked(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").count()
    size = -(-rows // 8)
    return union_all(
        [generate.generate_table(spark, CHUNKED, rows, SEED, start, size) for start in range(0, rows, size)]
    )


_values("gen_pk", lambda i: generate.surrogate_key("orders", SEED, i), f"{KEY} + {generate.key_base('orders', SEED)}")
_rule("gen_sequence", ValueRule("sequence", {"start": 10, "step": 2}), f"10 + {KEY} * 2")
_rule("gen_static", ValueRule("static", {"value": "fixed"}), "'fixed'")


@query(
    "gen_range",
    f"""SELECT {KEY} AS row_idx, {duck.randint(SEED, 'r.whole', KEY, 5, 10)} AS whole,
    floor((0.0::DOUBLE + {duck.uniform(SEED, 'r.real', KEY)} * 2.5::DOUBLE) * 10000.0::DOUBLE) / 10000.0::DOUBLE AS real,
    7.0::DOUBLE AS single, {duck.randint(SEED, 'r.open', KEY, 0, 40)} AS open_low FROM orders""",
)
def gen_range(spark: SparkSession, folder: str) -> DataFrame:
    def value(tag: str, **params) -> Column:
        return generate.rule_value(ValueRule("range", params), SEED, f"r.{tag}", "row_idx")

    return _positions(spark, folder).select(
        "row_idx",
        value("whole", min=5, max=10).alias("whole"),
        value("real", min=0.0, max=2.5).alias("real"),
        value("single", min=7, max=7).alias("single"),
        value("open", max=40).alias("open_low"),
    )


_rule(
    "gen_weighted_choice",
    ValueRule("weighted_choice", {"choices": ["new", "open", "done"], "weights": [5, 3, 2]}),
    duck.weighted(SEED, "gen_weighted_choice", KEY, ["new", "open", "done"], [5, 3, 2]),
)


def _uuid_sql(tag: str, key: str) -> str:
    digest = f"md5('{SEED}/{tag}/' || ({key})::VARCHAR)"
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return " || '-' || ".join(f"substr({digest}, {start}, {size})" for start, size in cuts)


_rule("gen_uuid", ValueRule("uuid"), _uuid_sql("gen_uuid", KEY))


def _pick(name: str, part: str, words, key: str = KEY) -> str:
    return duck.choose(SEED, f"{name}.{part}", key, words)


def _number(name: str, part: str, low: int, high: int, key: str = KEY) -> str:
    return duck.randint(SEED, f"{name}.{part}", key, low, high)


def _person_sql(name: str, lang: str = "en", key: str = KEY) -> str:
    first, last = providers.FIRST_NAMES[lang], providers.LAST_NAMES[lang]
    return f"{_pick(name, 'first', first, key)} || ' ' || {_pick(name, 'last', last, key)}"


def _email_sql(name: str, key: str = KEY) -> str:
    return (
        f"lower({_pick(name, 'first', providers.FIRST_NAMES['en'], key)}) || '.' || "
        f"lower({_pick(name, 'last', providers.LAST_NAMES['en'], key)}) || "
        f"{_number(name, 'number', 1, 9999, key)}::VARCHAR || '@example.' || "
        f"{_pick(name, 'domain', ['com', 'org', 'net'], key)}"
    )


def _phone_sql(name: str, key: str = KEY) -> str:
    return (
        f"'+1-' || {_number(name, 'area', 200, 999, key)}::VARCHAR || '-555-' || "
        f"lpad({_number(name, 'line', 0, 9999, key)}::VARCHAR, 4, '0')"
    )


def _url_sql(name: str, key: str = KEY) -> str:
    return (
        f"'https://' || {_pick(name, 'host', providers.WORDS, key)} || "
        f"{_number(name, 'number', 1, 999, key)}::VARCHAR || '.example.com/' || "
        f"{_pick(name, 'page', providers.WORDS, key)}"
    )


def _faker(provider: str) -> ValueRule:
    return ValueRule("faker", {"provider": provider})


@query(
    "gen_person",
    f"SELECT {KEY} AS row_idx, "
    + ", ".join(f"{_person_sql('gen_person', lang)} AS name_{lang}" for lang in ("en", "de", "es", "fr"))
    + " FROM orders",
)
def gen_person(spark: SparkSession, folder: str) -> DataFrame:
    def name(locale: str) -> Column:
        return generate.rule_value(_faker("person"), SEED, "gen_person", "row_idx", locale)

    return _positions(spark, folder).select(
        "row_idx", *[name(lang).alias(f"name_{lang}") for lang in ("en", "de", "es", "fr")]
    )


_rule("gen_email", _faker("email"), _email_sql("gen_email"))
_rule("gen_phone", _faker("phone"), _phone_sql("gen_phone"))
_rule(
    "gen_company", _faker("company"),
    f"{_pick('gen_company', 'owner', providers.LAST_NAMES['en'])} || ' ' || "
    f"{_pick('gen_company', 'suffix', providers.COMPANY_SUFFIXES['en'])}",
)
_rule(
    "gen_address", _faker("address"),
    f"{_number('gen_address', 'house', 1, 999)}::VARCHAR || ' ' || "
    f"{_pick('gen_address', 'street', providers.STREETS['en'])} || ', ' || "
    f"{_pick('gen_address', 'city', providers.CITIES['en'])}",
)
_rule("gen_city", _faker("city"), _pick("gen_city", "city", providers.CITIES["en"]))
_rule("gen_country", _faker("country"), _pick("gen_country", "country", providers.COUNTRY_CODES))
_rule("gen_url", _faker("url"), _url_sql("gen_url"))
_rule(
    "gen_nullable", ValueRule("sequence", {"start": 1, "step": 1, "null_probability": 0.3}),
    f"CASE WHEN {duck.uniform(SEED, 'gen_nullable.null', KEY)} >= 0.3::DOUBLE THEN 1 + {KEY} END",
)

providers.register("badge", lambda d: F.concat(F.lit("B-"), F.lpad(d.integer(0, 999, "no").cast("string"), 3, "0")))
_rule("custom_provider", _faker("badge"), f"'B-' || lpad({_number('custom_provider', 'no', 0, 999)}::VARCHAR, 3, '0')")


ALL_TYPES = TableSpec(
    "all_types",
    [
        ColumnSpec("id", "bigint"),
        ColumnSpec("code", "string", unique=True, max_length=20),
        ColumnSpec("title", "string", min_length=5, max_length=40),
        ColumnSpec("body", "text"),
        ColumnSpec("small", "integer", min_value=-5, max_value=5),
        ColumnSpec("big", "bigint"),
        ColumnSpec("real", "float", min_value=-1.0, max_value=1.0),
        ColumnSpec("dec", "decimal"),
        ColumnSpec("flag", "boolean"),
        ColumnSpec("day", "date"),
        ColumnSpec("at", "timestamp"),
        ColumnSpec("ref", "uuid"),
        ColumnSpec("mail", "email"),
        ColumnSpec("call", "phone"),
        ColumnSpec("site", "url"),
        ColumnSpec("state", "enum", enum=("active", "inactive", "banned")),
        ColumnSpec("price", "currency", max_value=250),
        ColumnSpec("share", "percent"),
        ColumnSpec("extra", "json"),
        ColumnSpec("person", "string", hint="full_name"),
    ],
    ["id"],
)


def _typed_sql() -> str:
    def u(column: str, part: str = "") -> str:
        return duck.uniform(SEED, f"all_types.{column}" + (f".{part}" if part else ""), KEY)

    def n(column: str, low: int, high: int, part: str = "") -> str:
        return duck.randint(SEED, f"all_types.{column}" + (f".{part}" if part else ""), KEY, low, high)

    def text(column: str, shortest: int, longest: int) -> str:
        words = " || ' ' || ".join(
            duck.choose(SEED, f"all_types.{column}.word{i}", KEY, providers.WORDS) for i in range(4)
        )
        return (
            f"substr(repeat({words} || '. ', 12), 1, "
            f"least(greatest(5, {n(column, shortest, longest, 'length')}), {longest})::INTEGER)"
        )

    def real(column: str, low: float, high: float, scale: int) -> str:
        return (
            f"floor(({low!r}::DOUBLE + {u(column)} * {high - low!r}::DOUBLE) * {float(scale)!r}::DOUBLE) "
            f"/ {float(scale)!r}::DOUBLE"
        )

    word = duck.choose(SEED, "all_types.code.word", KEY, providers.WORDS)
    day = "DATE '2020-01-01' + {}::INTEGER"
    columns = {
        "id": f"{KEY} + {generate.key_base('all_types', SEED)}",
        "code": f"substr({word} || '_' || {KEY}::VARCHAR || '_' || {n('code', 0, 999999, 'suffix')}::VARCHAR, 1, 20)",
        "title": text("title", 5, 40),
        "body": text("body", 1, 255),
        "small": n("small", -5, 5) + "::INTEGER",
        "big": n("big", 0, 2**31 - 1),
        "real": real("real", -1.0, 1.0, 10000),
        "dec": real("dec", 0.0, 1.0, 10000),
        "flag": f"{u('flag')} < 0.5",
        "day": day.format(n("day", 0, 1825, "day")),
        "at": f"TIMESTAMP '2020-01-01' + to_days({n('at', 0, 1825, 'day')}::INTEGER) "
              f"+ to_seconds({n('at', 0, 86400, 'second')})",
        "ref": _uuid_sql("all_types.ref", KEY),
        "mail": _email_sql("all_types.mail"),
        "call": _phone_sql("all_types.call"),
        "site": _url_sql("all_types.site"),
        "state": duck.choose(SEED, "all_types.state", KEY, ["active", "inactive", "banned"]),
        "price": real("price", 0.0, 250.0, 100),
        "share": real("share", 0.0, 1.0, 10000),
        "extra": f"'{{\"_placeholder\":' || {n('extra', 1, 99999)}::VARCHAR || '}}'",
        "person": _person_sql("all_types.person"),
    }
    return "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in columns.items()) + " FROM orders"


@query("gen_typed_row", _typed_sql())
def gen_typed_row(spark: SparkSession, folder: str) -> DataFrame:
    rows = generate.generate_rows(_positions(spark, folder), ALL_TYPES, SEED, keep_index=False)
    return rows.withColumns({c: F.col(c).cast("double") for c in ("dec", "price", "share")})


def _shape(name: str, kind: str, shape: Shape, oracle: str) -> None:
    """Register a distribution over order totals; the last digits of exponentials are engine specific."""

    @query(name, f"SELECT {KEY} AS row_idx, floor(({oracle}) * 10000.0::DOUBLE) / 10000.0::DOUBLE AS value FROM orders")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        value = apply_shape(F.col("o_totalprice"), kind, shape, SEED, name, KEY)
        return table(spark, folder, "orders").select(F.col(KEY).alias("row_idx"), floor_to(value, 4).alias("value"))


def _gauss_sql(name: str) -> str:
    radius = f"(({duck.draw(SEED, name + '.radius', KEY)} + 1)::DOUBLE / 4294967296.0::DOUBLE)"
    return f"sqrt(-2.0::DOUBLE * ln({radius})) * cos(6.283185307179586::DOUBLE * {duck.uniform(SEED, name + '.angle', KEY)})"


def _half_up(sql: str) -> str:
    return f"floor(({sql}) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE"


_shape("dist_normal", "float", Shape("normal", {"mu": 50, "sigma": 12.5}),
       _half_up(f"50.0::DOUBLE + 12.5::DOUBLE * {_gauss_sql('dist_normal')}"))
_shape("dist_lognormal", "float", Shape("lognormal", {"mu": 1, "sigma": 0.5}),
       _half_up(f"exp(1.0::DOUBLE + 0.5::DOUBLE * {_gauss_sql('dist_lognormal')})"))
_values(
    "dist_categorical",
    lambda i: apply_shape(
        F.lit("x"), "string", Shape("categorical", {"categories": ["gold", "silver", "basic"], "weights": [1, 3, 6]}),
        SEED, "dist_categorical", i,
    ),
    duck.weighted(SEED, "dist_categorical", KEY, ["gold", "silver", "basic"], [1, 3, 6]),
)
_AWAY = f"({duck.uniform(SEED, 'dist_seasonal', KEY)} - 0.25::DOUBLE)"
_shape("dist_seasonal", "float", Shape("seasonal", {"phase": 0.25, "amplitude": 2.0}),
       f"o_totalprice * (1.0::DOUBLE + 1.0::DOUBLE * exp(-20.0::DOUBLE * {_AWAY} * {_AWAY}))")
_SIZE = duck.uniform(SEED, "dist_long_tail.size", KEY)
_shape("dist_long_tail", "float", Shape("long_tail", {"head_ratio": 0.9, "tail_scale": 10.0}),
       f"CASE WHEN {duck.uniform(SEED, 'dist_long_tail.part', KEY)} < 0.9::DOUBLE "
       f"THEN o_totalprice * 1.0::DOUBLE * {_SIZE} "
       f"ELSE (CASE WHEN o_totalprice = 0 THEN 1.0::DOUBLE ELSE o_totalprice END) * 10.0::DOUBLE * (1.0::DOUBLE + {_SIZE}) END")


@query(
    "assign_fk",
    """WITH parents AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS position
                        FROM customer)
       SELECT o_orderkey, o_totalprice, c_custkey AS owner_key
       FROM orders JOIN parents ON position = o_orderkey % (SELECT count(*) FROM parents)""",
)
def assign_fk(spark: SparkSession, folder: str) -> DataFrame:
    owners = table(spark, folder, "customer")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return assign_foreign_key(orders, "o_orderkey", "owner_key", owners, "c_custkey")


SHOP = DatasetSpec(
    "shop",
    [
        TableSpec("customers", [ColumnSpec("id", "bigint"), ColumnSpec("email", "email")], ["id"]),
        TableSpec(
            "orders",
            [
                ColumnSpec("id", "bigint"), ColumnSpec("customer_id", "bigint"),
                ColumnSpec("status", "enum", enum=("active", "paid", "canceled")),
            ],
            ["id"],
        ),
        TableSpec(
            "order_items",
            [ColumnSpec("id", "bigint"), ColumnSpec("order_id", "bigint"),
             ColumnSpec("quantity", "integer", min_value=1, max_value=9)],
            ["id"],
        ),
    ],
    [ForeignKey("orders", ["customer_id"], "customers", ["id"]), ForeignKey("order_items", ["order_id"], "orders", ["id"])],
)


def _dataset_sql() -> str:
    base = {t: generate.key_base(t, SEED) for t in ("customers", "orders", "order_items")}
    return f"""
WITH n AS (SELECT count(*) AS c FROM customer),
c AS (SELECT unnest(range((SELECT c FROM n))) AS i),
o AS (SELECT unnest(range((SELECT 2 * c FROM n))) AS i),
l AS (SELECT unnest(range((SELECT 3 * c FROM n))) AS i)
SELECT 'customers' AS table_name, i + {base['customers']} AS id, NULL::BIGINT AS parent_id,
       {_email_sql('customers.email', 'i')} AS label FROM c
UNION ALL SELECT 'orders', i + {base['orders']}, i % (SELECT c FROM n) + {base['customers']},
       {duck.choose(SEED, 'orders.status', 'i', ['active', 'paid', 'canceled'])} FROM o
UNION ALL SELECT 'order_items', i + {base['order_items']}, i % (SELECT 2 * c FROM n) + {base['orders']},
       {duck.randint(SEED, 'order_items.quantity', 'i', 1, 9)}::VARCHAR FROM l"""


@query("gen_dataset", _dataset_sql())
def gen_dataset(spark: SparkSession, folder: str) -> DataFrame:
    made = generate.generate_dataset(spark, SHOP, table(spark, folder, "customer").count(), SEED)
    none = F.lit(None).cast("bigint")

    def rows(name: str, parent: Column, label: str) -> DataFrame:
        return made[name].select(
            F.lit(name).alias("table_name"), "id", parent.alias("parent_id"), F.col(label).cast("string").alias("label")
        )

    return union_all(
        [
            rows("customers", none, "email"),
            rows("orders", F.col("customer_id"), "status"),
            rows("order_items", F.col("order_id"), "quantity"),
        ]
    )


class Quarters:
    """A planner of a user's own: every fourth customer orders, and each order has four items."""

    def plan_row_counts(self, spec: DatasetSpec, scale: int, only: Sequence[str] | None = None) -> dict[str, int]:
        return {"customers": scale, "orders": scale // 4, "order_items": scale // 4 * 4}


PLANS: dict[str, str | RowPlanner] = {"by_name": "by_name", "quarters": Quarters(), "ratios": PerParent({"orders": 1.5, ("order_items", "orders"): 2})}
_PLAN_ROWS = {"by_name": ("c", "2 * c", "3 * c"), "quarters": ("c", "c // 4", "c // 4 * 4"), "ratios": ("c", "round_even(c * 1.5, 0)", "round_even(c * 1.5, 0) * 2")}


@query(
    "gen_dataset_planned",
    " UNION ALL ".join(
        f"""SELECT '{plan}' AS plan, '{name}' AS table_name, CAST({rows} AS BIGINT) AS made_rows,
        CAST({f"least({rows}, {up})" if up else "0"} AS BIGINT) AS parents_used FROM (SELECT count(*) AS c FROM customer)"""
        for plan, counts in _PLAN_ROWS.items() for name, rows, up in zip(("customers", "orders", "order_items"), counts, (None, *counts[:2]), strict=True)
    ),
)
def gen_dataset_planned(spark: SparkSession, folder: str) -> DataFrame:
    """Rows made under three planners, and how many parents have children then."""
    scale, parents = table(spark, folder, "customer").count(), {"customers": None, "orders": "customer_id", "order_items": "order_id"}
    parts = []
    for plan, planner in PLANS.items():
        for name, made in generate.generate_dataset(spark, SHOP, scale, SEED, planner=planner).items():
            used = F.countDistinct(parents[name]) if parents[name] else F.lit(0)
            parts.append(made.agg(F.lit(plan).alias("plan"), F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("made_rows"), used.cast("bigint").alias("parents_used")))
    return union_all(parts)


# Both columns of a line's key go to an event, from the same line

@query(
    "assign_fk_composite",
    """WITH parents AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS position FROM lineitem)
       SELECT event_id, l_orderkey AS order_key, l_linenumber AS line_number
       FROM events JOIN parents ON position = event_id % (SELECT count(*) FROM parents)""",
)
def assign_fk_composite(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id")
    return assign_foreign_key(events, "event_id", ["order_key", "line_number"], table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


NODE = {
    "$ref": "#/definitions/Node",
    "definitions": {"Node": {"type": "object", "properties": {
        "id": {"type": "integer"}, "next": {"$ref": "#/definitions/Node"}, "kids": {"type": "array", "items": {"$ref": "#/definitions/Node"}},
    }}},
}


def _node_sql(seed: str) -> str:
    return f"'{{\"id\":' || ({KEY} + {seed}) || ',\"next\":null,\"kids\":[]}}'"


@query(
    "gen_json_recursive",
    f"""SELECT {KEY} AS row_idx, '{{"id":' || {KEY} || ',"next":' || {_node_sql('7')} || ',"kids":[' || {_node_sql('14')} ||
    CASE WHEN ({KEY} + 14) % 3 = 0 THEN '' ELSE ',' || {_node_sql('15')} END || ']}}' AS value FROM orders""",
)
def gen_json_recursive(spark: SparkSession, folder: str) -> DataFrame:
    return _positions(spark, folder).select("row_idx", generate.json_records(F.col("row_idx"), NODE, depth=2).alias("value"))


RECORD = {
    "type": "object",
    "properties": {
        "id": {"type": "integer"},
        "name": {"type": "string"},
        "kind": {"enum": ["a", "b", "c"]},
        "when": {"type": "string", "format": "date"},
        "active": {"type": "boolean"},
        "owner": {"type": "object", "properties": {"id": {"type": "integer"}, "mail": {"type": "string", "format": "email"}}},
        "tags": {"type": "array", "items": {"type": "integer"}},
    },
}


@query(
    "gen_json_records",
    f"""SELECT {KEY} AS row_idx, '{{"id":' || {KEY} || ',"name":"sample_' || ({KEY} + 7) || '","kind":"' ||
    (['a','b','c'])[1 + ({KEY} + 14) % 3] || '","when":"2024-01-15","active":' || (({KEY} + 28) % 2 = 0) ||
    ',"owner":{{"id":' || ({KEY} + 35) || ',"mail":"user@example.com"}},"tags":[' || ({KEY} + 42) ||
    CASE WHEN ({KEY} + 42) % 3 = 0 THEN '' ELSE ',' || ({KEY} + 43) END || ']}}' AS value FROM orders""",
)
def gen_json_records(spark: SparkSession, folder: str) -> DataFrame:
    return _positions(spark, folder).select("row_idx", generate.json_records(F.col("row_idx"), RECORD).alias("value"))


@query(
    "pick_rows_exact",
    f"""WITH h AS (SELECT o_orderkey, {duck.draw(SEED, 'pick', KEY)} AS d FROM orders)
    SELECT o_orderkey FROM (SELECT *, row_number() OVER (ORDER BY d, o_orderkey) AS r FROM h)
    WHERE r <= greatest(1, floor((SELECT count(*) FROM orders) * 0.137::DOUBLE))""",
)
def pick_rows_exact(spark: SparkSession, folder: str) -> DataFrame:
    from rowloom.operators.selection import exact_share

    orders = table(spark, folder, "orders").select(KEY)
    return orders.filter(exact_share(orders, 0.137, SEED, "pick", KEY))
