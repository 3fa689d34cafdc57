"""Profiles, keys, references, rules, expectations and privacy on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import fixed_values as fixed
from rowloom.operators import expectations, integrity, keys, privacy, profile, report, rules
from rowloom.operators.expectations import Expectation
from rowloom.plans.catalog import counted_catalog, union_all
from rowloom.plans.joins import lookup
from rowloom.plans.spec import BusinessRule, ColumnSpec, DatasetSpec, ForeignKey, TableSpec
from rowloom.suite import duck
from rowloom.suite.degradation import INJECTED, RAW, injected_orders
from rowloom.suite.registry import TABLES, catalog_sql, query, table, tables

# Profiles


def _profile_sql(name: str) -> str:
    columns = list(TABLES[name])
    filled = " + ".join(f"count({c})" for c in columns)
    width = len(columns)
    return (
        f"SELECT '{name}' AS table_name, count(*) AS row_count, {width} AS column_count, "
        f"count(*) * {width} - ({filled}) AS null_count, "
        f"floor((count(*) * {width} - ({filled}))::DOUBLE / (count(*) * {width})::DOUBLE * 10000.0::DOUBLE "
        f"+ 0.5::DOUBLE) / 10000.0::DOUBLE AS null_ratio FROM {name}"
    )


DAMAGED_PROFILE = f"""WITH raw AS ({RAW}), damaged AS ({INJECTED}), n AS (SELECT count(*) AS r,
      count(*) * 6 - (count(o_orderkey) + count(o_custkey) + count(o_orderstatus) + count(o_totalprice)
      + count(o_orderdate) + count(o_orderpriority)) AS nulls FROM damaged)
    SELECT 'damaged' AS table_name, r AS row_count, 6 AS column_count, nulls AS null_count,
      floor(nulls::DOUBLE / (r * 6)::DOUBLE * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS null_ratio FROM n"""
PROFILES = " UNION ALL ".join(_profile_sql(t) for t in TABLES) + f" UNION ALL SELECT * FROM ({DAMAGED_PROFILE})"


def _profiled(spark: SparkSession, folder: str) -> DataFrame:
    return profile.table_profile({**tables(spark, folder), "damaged": injected_orders(spark, folder)})


@query("table_profile", PROFILES)
def table_profile(spark: SparkSession, folder: str) -> DataFrame:
    return _profiled(spark, folder)


@query(
    "dataset_summary",
    f"""SELECT sum(row_count)::BIGINT AS total_rows, count(*) AS total_tables, sum(null_count)::BIGINT AS total_nulls,
    sum(row_count * column_count)::BIGINT AS total_cells,
    floor(sum(null_count)::DOUBLE / sum(row_count * column_count)::DOUBLE * 10000.0::DOUBLE + 0.5::DOUBLE)
      / 10000.0::DOUBLE AS overall_null_ratio FROM ({PROFILES})""",
)
def dataset_summary(spark: SparkSession, folder: str) -> DataFrame:
    return profile.dataset_summary(_profiled(spark, folder))


@query(
    "schema_compliance",
    f"""WITH raw AS ({RAW}), damaged AS ({INJECTED})
    SELECT 'orders' AS table_name, * FROM (
      SELECT 'unexpected_column' AS finding, 'o_orderpriority' AS column_name, count(*) AS affected_rows FROM damaged
      UNION ALL SELECT 'required_null', 'o_custkey', count(*) FILTER (o_custkey IS NULL) FROM damaged
      UNION ALL SELECT 'required_null', 'o_clerk', count(*) FROM damaged) WHERE affected_rows > 0""",
)
def schema_compliance(spark: SparkSession, folder: str) -> DataFrame:
    return profile.schema_compliance(
        injected_orders(spark, folder), "orders",
        expected=["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_clerk"],
        required=["o_orderkey", "o_custkey", "o_clerk"],
    )


# Keys

LINE_ORDER = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with one sortable column that tells equal keys apart."""
    fields = [c.strip() for c in LINE_ORDER.split(",")]
    return table(spark, folder, "lineitem").withColumn("line_order", F.struct(*fields))


@query(
    "duplicate_pk_rows",
    f"""SELECT * FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE_ORDER}) > 1""",
)
def duplicate_pk_rows(spark: SparkSession, folder: str) -> DataFrame:
    return keys.repeated_rows(_lines(spark, folder), ["l_orderkey", "l_linenumber"], "line_order").drop("line_order")


@query(
    "duplicate_pk_rows_first_column",
    f"SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {LINE_ORDER}) > 1",
)
def duplicate_pk_rows_first_column(spark: SparkSession, folder: str) -> DataFrame:
    lines = _lines(spark, folder).withColumn("line_order", F.struct("l_linenumber", "line_order"))
    return keys.repeated_rows(lines, ["l_orderkey"], "line_order").drop("line_order")


@query(
    "duplicate_pk_keys",
    """SELECT 'lineitem' AS table_name, count(*) AS duplicate_keys, coalesce(sum(n - 1), 0)::BIGINT AS duplicate_rows
    FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
    UNION ALL SELECT 'orders', count(*), coalesce(sum(n - 1), 0)::BIGINT
    FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey HAVING count(*) > 1)""",
)
def duplicate_pk_keys(spark: SparkSession, folder: str) -> DataFrame:
    t = tables(spark, folder, "lineitem", "orders")
    return union_all(
        [
            keys.duplicate_totals(t["lineitem"], "lineitem", ["l_orderkey", "l_linenumber"]),
            keys.duplicate_totals(t["orders"], "orders", ["o_orderkey"]),
        ]
    )


# References: only customers with money and open or finished orders count as parents

LINKS = [
    ForeignKey("orders", ["o_custkey"], "solvent", ["c_custkey"]),
    ForeignKey("lineitem", ["l_orderkey"], "settled", ["o_orderkey"]),
    ForeignKey("lineitem", ["l_partkey"], "part", ["p_partkey"]),
]


def _linked(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    found = tables(spark, folder, "orders", "lineitem", "part", "customer")
    found["solvent"] = found["customer"].filter("c_acctbal > 0")
    found["settled"] = found["orders"].filter("o_orderstatus <> 'P'")
    return found


def _integrity_sql(label: str, child: str, fk: str, parent: str, pk: str) -> str:
    return f"""SELECT '{label}' AS foreign_key, count(*) AS orphan_rows, count(DISTINCT {fk}) AS orphan_values,
    min({fk}::VARCHAR) AS sample_value, count(*) = 0 AS intact FROM {child}
    WHERE {fk} IS NOT NULL AND {fk} NOT IN (SELECT {pk} FROM {parent})"""


SOLVENT = "(SELECT * FROM customer WHERE c_acctbal > 0)"
SETTLED = "(SELECT * FROM orders WHERE o_orderstatus <> 'P')"
INTEGRITY = " UNION ALL ".join(
    [
        _integrity_sql("orders.o_custkey->solvent", "orders", "o_custkey", SOLVENT, "c_custkey"),
        _integrity_sql("lineitem.l_orderkey->settled", "lineitem", "l_orderkey", SETTLED, "o_orderkey"),
        _integrity_sql("lineitem.l_partkey->part", "lineitem", "l_partkey", "part", "p_partkey"),
    ]
)


@query("ref_integrity", INTEGRITY)
def ref_integrity(spark: SparkSession, folder: str) -> DataFrame:
    return integrity.ref_integrity(_linked(spark, folder), LINKS)


ROW_KEYS = {"orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"]}


def _sample_sql(fk: ForeignKey, parent: str) -> str:
    column, key = fk.child_columns[0], ROW_KEYS[fk.child]
    order = ", ".join(dict.fromkeys([*key, column]))
    row = " || '|' || ".join(f"{c}::VARCHAR" for c in key)
    return f"""SELECT '{fk.name}' AS foreign_key, n::INT AS sample_no, {row} AS row_key, {column}::VARCHAR AS value,
    '{fk.child}.{column} of row ' || {row} || ' is ' || {column} || ', which {fk.parent} lacks' AS message
    FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS n FROM {fk.child}
      WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {fk.parent_columns[0]} FROM {parent})) WHERE n <= 5"""


@query("ref_orphan_samples", " UNION ALL ".join(_sample_sql(fk, parent) for fk, parent in zip(LINKS, (SOLVENT, SETTLED, "part"), strict=True)))
def ref_orphan_samples(spark: SparkSession, folder: str) -> DataFrame:
    return integrity.orphan_samples(_linked(spark, folder), LINKS, ROW_KEYS)


@query("ref_orphan_rows", f"SELECT * FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM {SETTLED})")
def ref_orphan_rows(spark: SparkSession, folder: str) -> DataFrame:
    t = _linked(spark, folder)
    return integrity.orphan_rows(t["lineitem"], ["l_orderkey"], t["settled"], ["o_orderkey"])


@query(
    "validity_score",
    f"""WITH e AS (SELECT sum(orphan_rows)::BIGINT AS n FROM ({INTEGRITY})),
    r AS (SELECT ((SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem)) AS n)
    SELECT r.n AS total_rows, e.n AS reference_errors,
    greatest(0.0::DOUBLE, 1.0::DOUBLE - e.n::DOUBLE / greatest(r.n, 1)::DOUBLE * 0.1::DOUBLE) AS schema_validity_score
    FROM e, r""",
)
def validity_score(spark: SparkSession, folder: str) -> DataFrame:
    t = _linked(spark, folder)
    rows = profile.dataset_summary(profile.table_profile({k: t[k] for k in ("orders", "lineitem")}))
    errors = integrity.ref_integrity(t, LINKS).agg(F.sum("orphan_rows").alias("reference_errors"))
    return profile.validity_score(rows, errors)


# Rules

ORDER_RULE = BusinessRule("ships_after_order", "order", "lines", expression="o_orderdate <= l_shipdate")
RANGE_RULE = BusinessRule("quantity_range", "range", "lineitem", fields=["l_quantity", "l_linenumber"],
                          params={"min": 2, "max": 40})
EQUAL_RULE = BusinessRule("unit_price", "equality", "lineitem",
                          expression="round(l_extendedprice) == l_quantity * l_linenumber * 100")
ENUM_RULE = BusinessRule("known_flag", "enum", "lineitem", fields=["l_returnflag"], params={"values": ["A", "N"]})
PATTERN_RULE = BusinessRule("status_pattern", "pattern", "lineitem", fields=["l_linestatus"], params={"pattern": "^[FX]$"})
CUSTOM_RULE = BusinessRule("cheap_or_taxed", "custom", "lineitem", expression="l_extendedprice < 50000 OR l_tax > 0.02")
CALLBACK_RULE = BusinessRule("low_discount", "custom", "lineitem",
                             params={"callback": lambda: F.col("l_discount") <= F.lit(0.08)})
UNIQUE_RULE = BusinessRule("line_key", "uniqueness", "lineitem", fields=["l_orderkey", "l_linenumber"])
REFERENCE_RULE = BusinessRule("settled_order", "reference", "lineitem", fields=["l_orderkey"],
                              params={"parent": "settled", "parent_columns": ["o_orderkey"]})
SUM_RULE = BusinessRule("order_total", "sum", "orders", params={
    "total_field": "o_totalprice", "parent_key": "o_orderkey", "child_table": "lineitem",
    "child_key": "l_orderkey", "child_field": "l_extendedprice", "tolerance": 200000.0,
})
LINE_RULES = [RANGE_RULE, EQUAL_RULE, ENUM_RULE, PATTERN_RULE, CUSTOM_RULE, CALLBACK_RULE]

BROKEN = {
    "ships_after_order": "NOT (o_orderdate <= l_shipdate)",
    "quantity_range": "l_quantity < 2 OR l_quantity > 40 OR l_linenumber < 2 OR l_linenumber > 40",
    "unit_price": "round(l_extendedprice) <> l_quantity * l_linenumber * 100",
    "known_flag": "l_returnflag NOT IN ('A', 'N')",
    "status_pattern": "NOT regexp_matches(l_linestatus, '^[FX]$')",
    "cheap_or_taxed": "NOT (l_extendedprice < 50000 OR l_tax > 0.02)",
    "low_discount": "NOT l_discount <= 0.08",
}
ORDER_LINES = "(SELECT l.*, o_orderdate FROM lineitem l JOIN orders ON l_orderkey = o_orderkey)"
SUM_BROKEN = """SELECT o.*, coalesce(s, 0)::DOUBLE AS children_sum FROM orders o LEFT JOIN
    (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(28,6)) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
    WHERE abs(o_totalprice - coalesce(s, 0)::DOUBLE) > 200000.0"""


def _ruled(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    t = _linked(spark, folder)
    dated = t["orders"].select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    t["lines"] = lookup(t["lineitem"], dated, ["l_orderkey"], "inner")
    return t


def _rule_query(name: str, rule: BusinessRule, relation: str) -> None:
    """Register the rows that break one rule."""

    @query(name, f"SELECT * FROM {relation} WHERE {BROKEN[rule.name]}")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _ruled(spark, folder)[rule.table].filter(rules.violated(rule))


_rule_query("rule_order", ORDER_RULE, ORDER_LINES)
_rule_query("rule_range", RANGE_RULE, "lineitem")
_rule_query("rule_equality", EQUAL_RULE, "lineitem")
_rule_query("rule_enum", ENUM_RULE, "lineitem")
_rule_query("rule_pattern", PATTERN_RULE, "lineitem")
_rule_query("rule_custom", CUSTOM_RULE, "lineitem")


@query("rule_sum", SUM_BROKEN)
def rule_sum(spark: SparkSession, folder: str) -> DataFrame:
    t = tables(spark, folder, "orders", "lineitem")
    return rules.sum_violations(t["orders"], t["lineitem"], SUM_RULE)


UNIQUE_SQL = """SELECT coalesce(sum(n - 1), 0)::BIGINT AS violations FROM
    (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)"""
REFERENCE_SQL = f"SELECT count(*) AS violations FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM {SETTLED})"


@query("rule_unique", f"SELECT 'lineitem' AS table_name, 'line_key' AS rule, 'uniqueness' AS kind, * FROM ({UNIQUE_SQL})")
def rule_unique(spark: SparkSession, folder: str) -> DataFrame:
    return rules.rule_violations(_linked(spark, folder), [UNIQUE_RULE])


@query("rule_reference", f"SELECT 'lineitem' AS table_name, 'settled_order' AS rule, 'reference' AS kind, * FROM ({REFERENCE_SQL})")
def rule_reference(spark: SparkSession, folder: str) -> DataFrame:
    return rules.rule_violations(_linked(spark, folder), [REFERENCE_RULE])


VIOLATIONS = " UNION ALL ".join(
    f"SELECT 'lineitem' AS table_name, '{r.name}' AS rule, '{r.kind}' AS kind, "
    f"count(*) FILTER ({BROKEN[r.name]}) AS violations FROM lineitem"
    for r in LINE_RULES
) + f"""
    UNION ALL SELECT 'lines', 'ships_after_order', 'order', count(*) FILTER (NOT (o_orderdate <= l_shipdate)) FROM {ORDER_LINES}
    UNION ALL SELECT 'lineitem', 'line_key', 'uniqueness', * FROM ({UNIQUE_SQL})
    UNION ALL SELECT 'lineitem', 'settled_order', 'reference', * FROM ({REFERENCE_SQL})
    UNION ALL SELECT 'orders', 'order_total', 'sum', count(*) FROM ({SUM_BROKEN})"""


@query("rule_violations", VIOLATIONS)
def rule_violations(spark: SparkSession, folder: str) -> DataFrame:
    return rules.rule_violations(
        _ruled(spark, folder), [*LINE_RULES, ORDER_RULE, UNIQUE_RULE, REFERENCE_RULE, SUM_RULE]
    )


SAMPLED = [
    Expectation(expectations.NOT_NULL, "o_custkey"), Expectation(expectations.IN_SET, "o_orderstatus", value_set=("active", "paid")),
    Expectation(expectations.UNIQUE, "o_orderkey"),
]


@query(
    "exp_samples",
    f"""WITH raw AS ({RAW}), damaged AS ({INJECTED}), s AS (
      SELECT 0 AS seq, '{expectations.NOT_NULL}' AS expectation, 'o_custkey' AS column_name, o_orderkey AS k, o_custkey AS value
        FROM damaged WHERE o_custkey IS NULL
      UNION ALL SELECT 1, '{expectations.IN_SET}', 'o_orderstatus', o_orderkey, o_orderstatus FROM damaged WHERE o_orderstatus NOT IN ('active', 'paid')),
    r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY k, value) AS sample_no FROM s),
    u AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM damaged GROUP BY 1 HAVING count(*) > 1)
    SELECT 'damaged_suite' AS suite, seq, expectation, column_name, sample_no, k::VARCHAR AS row_key, value FROM r WHERE sample_no <= 5
    UNION ALL SELECT 'damaged_suite', 2, '{expectations.UNIQUE}', 'o_orderkey', n, NULL, o_orderkey::VARCHAR FROM u WHERE n <= 5""",
)
def exp_samples(spark: SparkSession, folder: str) -> DataFrame:
    return expectations.failing_samples(injected_orders(spark, folder), "damaged", SAMPLED, "o_orderkey")


# Raw text with damaged cells: what doesn't parse can't break an order or range rule

DIRTY_RULES = [
    BusinessRule("raw_total_range", "range", "damaged", fields=["o_totalprice"], params={"min": 5000, "max": 450000}),
    BusinessRule("raw_owner_order", "order", "damaged", expression="o_custkey <= o_orderkey"),
    BusinessRule("raw_priority_order", "order", "damaged", expression="o_orderpriority <= o_totalprice"),
]
DIRTY_BROKEN = {
    "raw_total_range": "coalesce(TRY_CAST(o_totalprice AS DOUBLE) < 5000 OR TRY_CAST(o_totalprice AS DOUBLE) > 450000, false)",
    "raw_owner_order": "coalesce(TRY_CAST(o_custkey AS DOUBLE) > o_orderkey, false)",
    "raw_priority_order": "coalesce(CASE WHEN TRY_CAST(o_orderpriority AS DOUBLE) IS NOT NULL AND TRY_CAST(o_totalprice AS DOUBLE)"
    " IS NOT NULL THEN TRY_CAST(o_orderpriority AS DOUBLE) > TRY_CAST(o_totalprice AS DOUBLE) ELSE o_orderpriority > o_totalprice END, false)",
}
REPORT_SUITES = {
    "lineitem": [Expectation(expectations.NOT_NULL, "l_orderkey"), Expectation(expectations.BETWEEN, "l_quantity", min_value=2, max_value=49)],
    "damaged": [Expectation(expectations.NOT_NULL, "o_custkey"),
                Expectation(expectations.IN_SET, "o_orderstatus", value_set=("paid", "active"))],
}


def _report_sql(name: str, relation: str, columns: list[str], broken: dict[str, str], suite: dict[tuple[str, str], str]) -> str:
    checks = [("nulls", c, f"{c} IS NULL") for c in columns] + [("rule", n, sql) for n, sql in broken.items()]
    checks += [(kind, c, sql) for (kind, c), sql in suite.items()]
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, '{kind}' AS \"check\", '{subject}' AS subject, count(*) FILTER ({sql}) AS failing, "
        f"count(*) AS total_rows FROM {relation}" for kind, subject, sql in checks
    )


REPORT_SQL = f"WITH raw AS ({RAW}), damaged AS ({INJECTED}) " + _report_sql(
    "lineitem", "lineitem", list(TABLES["lineitem"]), {r.name: BROKEN[r.name] for r in LINE_RULES},
    {(expectations.NOT_NULL, "l_orderkey"): "l_orderkey IS NULL", (expectations.BETWEEN, "l_quantity"): "l_quantity < 2 OR l_quantity > 49"},
) + " UNION ALL " + _report_sql(
    "damaged", "damaged", list(TABLES["orders"]), DIRTY_BROKEN,
    {(expectations.NOT_NULL, "o_custkey"): "o_custkey IS NULL", (expectations.IN_SET, "o_orderstatus"): "o_orderstatus NOT IN ('paid', 'active')"},
)


@query("quality_report", REPORT_SQL)
def quality_report(spark: SparkSession, folder: str) -> DataFrame:
    read = {"lineitem": table(spark, folder, "lineitem"), "damaged": injected_orders(spark, folder)}
    return report.quality_report(read, [*LINE_RULES, *DIRTY_RULES], REPORT_SUITES)


ORDER_RULES = [
    BusinessRule("total_range", "range", "orders", fields=["o_totalprice"], params={"min": 5000, "max": 450000}),
    BusinessRule("closed_status", "enum", "orders", fields=["o_orderstatus"], params={"values": ["F", "O"]}),
    BusinessRule("urgent_total", "custom", "orders", expression="o_orderpriority <> '1-URGENT' OR o_totalprice > 100000"),
]
SAMPLES = """WITH broken AS (
      SELECT *, 'total_range' AS rule FROM orders WHERE o_totalprice < 5000 OR o_totalprice > 450000
      UNION ALL SELECT *, 'closed_status' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
      UNION ALL SELECT *, 'urgent_total' FROM orders WHERE NOT (o_orderpriority <> '1-URGENT' OR o_totalprice > 100000)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY o_orderkey)::INTEGER AS sample_no FROM broken)
    SELECT *, 'orders' AS table_name FROM ranked WHERE sample_no <= 10 ORDER BY o_orderkey, rule LIMIT 50"""


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    return rules.violation_samples(table(spark, folder, "orders"), "orders", ORDER_RULES, "o_orderkey")


@query("violation_samples", SAMPLES)
def violation_samples(spark: SparkSession, folder: str) -> DataFrame:
    return _samples(spark, folder)


# Expectations

QUALITY = DatasetSpec(
    "sales",
    [
        TableSpec("customer", [ColumnSpec("c_custkey", "bigint"), ColumnSpec("c_mktsegment", "enum",
                  enum=("BUILDING", "FURNITURE", "MACHINERY"))], ["c_custkey"]),
        TableSpec("orders", [ColumnSpec("o_orderkey", "bigint"), ColumnSpec("o_custkey", "bigint"),
                  ColumnSpec("o_orderstatus", "enum", enum=("F", "O"))], ["o_orderkey"]),
        TableSpec("lineitem", [ColumnSpec("l_orderkey", "bigint"), ColumnSpec("l_linenumber", "integer"),
                  ColumnSpec("l_quantity", "float")], ["l_orderkey", "l_linenumber"]),
    ],
    [ForeignKey("orders", ["o_custkey"], "customer", ["c_custkey"]),
     ForeignKey("lineitem", ["l_orderkey"], "orders", ["o_orderkey"])],
)
SUITE_RULES = [
    BusinessRule("quantity", "range", "lineitem", fields=["l_quantity"], params={"min": 1, "max": 40}),
    BusinessRule("priority", "enum", "orders", fields=["o_orderpriority"],
                 params={"values": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}),
]
SUITE_TABLES = ("customer", "orders", "lineitem")

SUITE_ROWS = [
    ("customer", 0, expectations.ROW_COUNT, None, '{"min_value": 1, "max_value": null}', "(count(*) < 1)::BIGINT"),
    ("customer", 1, expectations.NOT_NULL, "c_custkey", '{"column": "c_custkey"}', "count(*) FILTER (c_custkey IS NULL)"),
    ("customer", 2, expectations.UNIQUE, "c_custkey", '{"column": "c_custkey"}', "UNIQUE"),
    ("customer", 3, expectations.IN_SET, "c_mktsegment",
     '{"column": "c_mktsegment", "value_set": ["BUILDING", "FURNITURE", "MACHINERY"]}',
     "count(*) FILTER (c_mktsegment NOT IN ('BUILDING', 'FURNITURE', 'MACHINERY'))"),
    ("orders", 0, expectations.ROW_COUNT, None, '{"min_value": 1, "max_value": null}', "(count(*) < 1)::BIGINT"),
    ("orders", 1, expectations.NOT_NULL, "o_orderkey", '{"column": "o_orderkey"}', "count(*) FILTER (o_orderkey IS NULL)"),
    ("orders", 2, expectations.UNIQUE, "o_orderkey", '{"column": "o_orderkey"}', "UNIQUE"),
    ("orders", 3, expectations.NOT_NULL, "o_custkey", '{"column": "o_custkey"}', "count(*) FILTER (o_custkey IS NULL)"),
    ("orders", 4, expectations.IN_SET, "o_orderstatus", '{"column": "o_orderstatus", "value_set": ["F", "O"]}',
     "count(*) FILTER (o_orderstatus NOT IN ('F', 'O'))"),
    ("orders", 5, expectations.IN_SET, "o_orderpriority",
     '{"column": "o_orderpriority", "value_set": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}',
     "count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))"),
    ("lineitem", 0, expectations.ROW_COUNT, None, '{"min_value": 1, "max_value": null}', "(count(*) < 1)::BIGINT"),
    ("lineitem", 1, expectations.NOT_NULL, "l_orderkey", '{"column": "l_orderkey"}', "count(*) FILTER (l_orderkey IS NULL)"),
    ("lineitem", 2, expectations.UNIQUE, "l_orderkey", '{"column": "l_orderkey"}', "UNIQUE"),
    ("lineitem", 3, expectations.NOT_NULL, "l_linenumber", '{"column": "l_linenumber"}',
     "count(*) FILTER (l_linenumber IS NULL)"),
    ("lineitem", 4, expectations.UNIQUE, "l_linenumber", '{"column": "l_linenumber"}', "UNIQUE"),
    ("lineitem", 5, expectations.BETWEEN, "l_quantity", '{"column": "l_quantity", "min_value": 1, "max_value": 40}',
     "count(*) FILTER (l_quantity < 1 OR l_quantity > 40)"),
]


def _suites() -> dict[str, list[Expectation]]:
    return {t: expectations.derive_suite(QUALITY, t, SUITE_RULES) for t in SUITE_TABLES}


def _named(value: str | None) -> str:
    return "NULL::VARCHAR" if value is None else duck.quoted(value)


def _run_sql(rows) -> str:
    parts = []
    for t, seq, kind, column, _, failing in rows:
        counted = (
            f"(SELECT count(*) AS failing FROM (SELECT {column} FROM {t} GROUP BY {column} HAVING count(*) > 1))"
            if failing == "UNIQUE" else f"(SELECT {failing} AS failing FROM {t})"
        )
        parts.append(
            f"SELECT '{t}_suite' AS suite, {seq} AS seq, '{kind}' AS expectation, {_named(column)} AS column_name, "
            f"failing, failing = 0 AS passed FROM {counted}"
        )
    return " UNION ALL ".join(parts)


@query(
    "build_suite",
    "SELECT suite, seq, expectation, column_name, kwargs, row_count FROM (VALUES "
    + ", ".join(f"('{t}', '{t}_suite', {s}, '{k}', {_named(c)}, {duck.quoted(w)})" for t, s, k, c, w, _ in SUITE_ROWS)
    + ") AS v(t, suite, seq, expectation, column_name, kwargs) JOIN ("
    + " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS row_count FROM {t}" for t in SUITE_TABLES)
    + ") USING (t)",
)
def build_suite(spark: SparkSession, folder: str) -> DataFrame:
    sizes = profile.row_counts(tables(spark, folder, *SUITE_TABLES)).select(
        F.concat("table_name", F.lit("_suite")).alias("suite"), "row_count"
    )
    return expectations.suite_rows(spark, _suites()).join(sizes, "suite")


@query("run_suites", _run_sql(SUITE_ROWS))
def run_suites(spark: SparkSession, folder: str) -> DataFrame:
    return expectations.run_suites(tables(spark, folder, *SUITE_TABLES), _suites())


@query(
    "suite_verdicts",
    f"""SELECT suite, count(*) AS expectations, count(*) FILTER (NOT passed) AS failed_expectations,
    bool_and(passed) AS suite_passed FROM ({_run_sql(SUITE_ROWS)}) GROUP BY suite""",
)
def suite_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return expectations.suite_verdicts(
        expectations.run_suites(tables(spark, folder, *SUITE_TABLES), _suites())
    )


def _expectation(name: str, relation: str, suite: list[Expectation], oracle: str, source) -> None:
    @query(name, oracle)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return expectations.run_suite(source(spark, folder), relation, suite)


def _suite_sql(relation: str, rows: list[tuple[str, str | None, str]], prefix: str = "", source: str | None = None) -> str:
    return prefix + " UNION ALL ".join(
        f"SELECT '{relation}_suite' AS suite, {i} AS seq, '{kind}' AS expectation, {_named(column)} AS column_name, "
        f"failing, failing = 0 AS passed FROM ({sql})"
        for i, (kind, column, sql) in enumerate(rows)
    )


DAMAGED = f"WITH raw AS ({RAW}), damaged AS ({INJECTED}) "
_expectation(
    "exp_row_count", "events", [Expectation(expectations.ROW_COUNT, min_value=1, max_value=500),
                                Expectation(expectations.ROW_COUNT, min_value=1)],
    _suite_sql("events", [(expectations.ROW_COUNT, None, "SELECT (count(*) < 1 OR count(*) > 500)::BIGINT AS failing FROM events"),
                          (expectations.ROW_COUNT, None, "SELECT (count(*) < 1)::BIGINT AS failing FROM events")]),
    lambda spark, folder: table(spark, folder, "events"),
)
_expectation(
    "exp_not_null", "damaged", [Expectation(expectations.NOT_NULL, c) for c in ("o_orderkey", "o_custkey", "o_orderdate")],
    _suite_sql("damaged", [(expectations.NOT_NULL, c, f"SELECT count(*) FILTER ({c} IS NULL) AS failing FROM damaged")
                           for c in ("o_orderkey", "o_custkey", "o_orderdate")], DAMAGED),
    injected_orders,
)
_expectation(
    "exp_unique", "damaged", [Expectation(expectations.UNIQUE, c) for c in ("o_orderkey", "o_orderdate")],
    _suite_sql("damaged", [(expectations.UNIQUE, c,
                            f"SELECT count(*) AS failing FROM (SELECT {c} FROM damaged GROUP BY {c} HAVING count(*) > 1)")
                           for c in ("o_orderkey", "o_orderdate")], DAMAGED),
    injected_orders,
)
_expectation(
    "exp_in_set", "damaged", [Expectation(expectations.IN_SET, "o_orderstatus", value_set=("active", "paid", "pending"))],
    _suite_sql("damaged", [(expectations.IN_SET, "o_orderstatus",
                            "SELECT count(*) FILTER (o_orderstatus NOT IN ('active', 'paid', 'pending')) AS failing FROM damaged")],
               DAMAGED),
    injected_orders,
)
_expectation(
    "exp_between", "damaged", [Expectation(expectations.BETWEEN, "o_totalprice", min_value=5000, max_value=400000)],
    _suite_sql("damaged", [(expectations.BETWEEN, "o_totalprice",
                            "SELECT count(*) FILTER (try_cast(o_totalprice AS DOUBLE) < 5000 OR "
                            "try_cast(o_totalprice AS DOUBLE) > 400000) AS failing FROM damaged")], DAMAGED),
    injected_orders,
)


@query("pk_tests", _run_sql([r for r in SUITE_ROWS if r[2] in (expectations.NOT_NULL, expectations.UNIQUE)
                             and r[3] in ("c_custkey", "o_orderkey", "l_orderkey", "l_linenumber")]))
def pk_tests(spark: SparkSession, folder: str) -> DataFrame:
    suites = {t: expectations.derive_suite(QUALITY, t) for t in SUITE_TABLES}
    keyed = {t: set(QUALITY.table(t).primary_key) for t in SUITE_TABLES}
    results = expectations.run_suites(tables(spark, folder, *SUITE_TABLES), suites)
    chosen = F.lit(False)
    for t, columns in keyed.items():
        chosen = chosen | ((F.col("suite") == f"{t}_suite") & F.col("column_name").isin(*columns))
    return results.filter(chosen & F.col("expectation").isin(expectations.NOT_NULL, expectations.UNIQUE))


# Privacy, over the measured column catalog of all tables

OVERRIDES = {("conversations", "text"): "free_text_sensitive", ("documents", "text"): "free_text_sensitive"}


def _match_sql(position: int) -> str:
    lines = " ".join(
        "WHEN " + " OR ".join(f"contains(lower(column_name), '{p}')" for p in line[2]) + f" THEN '{line[position]}'"
        for line in fixed.NAME_PATTERNS
    )
    return f"CASE {lines} ELSE 'unclassified' END"


def _override_sql(value: str, otherwise: str) -> str:
    return (
        f"CASE WHEN table_name IN ('conversations', 'documents') AND column_name = 'text' THEN '{value}' "
        f"ELSE {otherwise} END"
    )


CLASSIFIED = f"""SELECT *, {_override_sql('free_text_sensitive', _match_sql(0))} AS category,
    {_override_sql('detected', _match_sql(1))} AS certainty,
    {_override_sql('override', f"CASE WHEN {_match_sql(0)} <> 'unclassified' THEN 'pattern' ELSE 'none' END")} AS decided_by
    FROM ({catalog_sql()})"""


def classified(spark: SparkSession, folder: str) -> DataFrame:
    return privacy.classify(counted_catalog(tables(spark, folder)), OVERRIDES)


@query("pii_classify", CLASSIFIED)
def pii_classify(spark: SparkSession, folder: str) -> DataFrame:
    return classified(spark, folder)


@query(
    "pii_warnings",
    f"""SELECT table_name, column_name, row_count, CASE WHEN certainty = 'suspected' THEN 'Detected suspected ' ELSE
    'Detected ' END || category || ' field: ' || table_name || '.' || column_name AS warning FROM ({CLASSIFIED})
    WHERE decided_by = 'pattern' AND (certainty = 'suspected' OR category IN ('credentials', 'financial'))""",
)
def pii_warnings(spark: SparkSession, folder: str) -> DataFrame:
    return privacy.warnings(classified(spark, folder)).select("table_name", "column_name", "row_count", "warning")


CUSTOMER_CATEGORIES = {"c_name": "name", "c_mktsegment": "credentials", "c_acctbal": "email"}


@query(
    "redact",
    """SELECT c_custkey, CASE WHEN c_name IS NOT NULL THEN '***REDACTED***' END AS c_name, c_nationkey,
    CASE WHEN c_acctbal IS NOT NULL THEN '***@***' END AS c_acctbal,
    CASE WHEN c_mktsegment IS NOT NULL THEN '***SECRET***' END AS c_mktsegment FROM customer""",
)
def redact(spark: SparkSession, folder: str) -> DataFrame:
    return privacy.redact(table(spark, folder, "customer"), CUSTOMER_CATEGORIES)


SUMMARY = f"""SELECT category, count(*) AS sensitive_columns,
    category IN ('credentials', 'financial', 'government_id') AS high_risk
    FROM ({CLASSIFIED}) WHERE category <> 'unclassified' GROUP BY category"""


@query("pii_summary", SUMMARY)
def pii_summary(spark: SparkSession, folder: str) -> DataFrame:
    return privacy.category_summary(classified(spark, folder))


WEIGHTS = "CASE category " + " ".join(f"WHEN '{c}' THEN {w}" for c, w in fixed.RISK_WEIGHTS.items()) + " ELSE 1 END"
SCORES = f"""SELECT sensitive_categories, sensitive_columns, risk_score, CASE WHEN risk_score >= 70 THEN 'high'
    WHEN risk_score >= 40 THEN 'medium' ELSE 'low' END AS risk_level, high_risk_categories FROM (
    SELECT count(*) AS sensitive_categories, sum(sensitive_columns)::BIGINT AS sensitive_columns,
    least(100, sum({WEIGHTS} * sensitive_columns) * 3)::BIGINT AS risk_score,
    coalesce(string_agg(category, ',' ORDER BY category) FILTER (high_risk), '') AS high_risk_categories FROM ({SUMMARY}))"""


@query("privacy_scorecard", SCORES)
def privacy_scorecard(spark: SparkSession, folder: str) -> DataFrame:
    return privacy.scorecard(privacy.category_summary(classified(spark, folder))).drop("categories")


POLICIES = [
    privacy.Policy("enforce", "strict", 30, 5, True, ("name", "health")),
    privacy.Policy("advisory", "warn", 99, None, False, ("date_of_birth",)),
    privacy.Policy("enforce", "off", None, 500),
]


def _decision_sql(policy: privacy.Policy) -> str:
    checks = []
    if policy.max_risk_score is not None:
        checks.append(f"CASE WHEN risk_score > {policy.max_risk_score} THEN 'risk_score_exceeds_threshold:' || "
                      f"risk_score || '>{policy.max_risk_score}' END")
    if policy.max_sensitive_columns is not None:
        checks.append(f"CASE WHEN sensitive_columns > {policy.max_sensitive_columns} THEN "
                      f"'sensitive_columns_exceed_threshold:' || sensitive_columns || '>{policy.max_sensitive_columns}' END")
    if policy.fail_on_high_risk and policy.privacy_mode == "strict":
        checks.append("CASE WHEN high_risk_categories <> '' THEN 'high_risk_categories_present:' || high_risk_categories END")
    checks += [f"CASE WHEN EXISTS (SELECT 1 FROM s WHERE category = '{c}') THEN 'blocked_category_detected:{c}' END"
               for c in sorted(policy.block_categories)]
    count = " + ".join(f"(({c}) IS NOT NULL)::INTEGER" for c in checks)
    worst = "block" if policy.mode == "enforce" else "warn"
    return f"""SELECT risk_score, risk_level, sensitive_columns, ({count})::INTEGER AS violation_count,
      concat_ws(';', {', '.join(checks)}) AS violations, '{policy.mode}' AS policy_mode,
      CASE WHEN ({count}) > 0 THEN '{worst}' ELSE 'allow' END AS policy_decision FROM c"""


@query("privacy_policy", f"WITH s AS ({SUMMARY}), c AS ({SCORES}) " + " UNION ALL ".join(map(_decision_sql, POLICIES)))
def privacy_policy(spark: SparkSession, folder: str) -> DataFrame:
    scores = privacy.scorecard(privacy.category_summary(classified(spark, folder)))
    return privacy.decide(scores, *POLICIES)


@query(
    "redaction_audit",
    f"""WITH s AS ({SAMPLES}), p AS (SELECT table_name, count(*) AS n FROM ({CLASSIFIED})
      WHERE category <> 'unclassified' GROUP BY table_name)
    SELECT s.table_name, count(*) AS samples, coalesce(any_value(n), 0) AS sensitive_columns,
    count(*) * coalesce(any_value(n), 0) AS redactions_applied FROM s LEFT JOIN p ON p.table_name = s.table_name GROUP BY 1""",
)
def redaction_audit(spark: SparkSession, folder: str) -> DataFrame:
    # Orders hold no personal columns by name; the priority is declared sensitive here.
    return privacy.redaction_audit(_samples(spark, folder), classified(spark, folder))
