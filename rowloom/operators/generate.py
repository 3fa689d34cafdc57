"""Table generation: projections over a row index."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import providers, rng
from rowloom.functions.shapes import apply_shape, floor_to
from rowloom.plans.planning import RowPlanner, planned_rows
from rowloom.plans.pointers import follow
from rowloom.plans.spec import (
    LOGICAL_TYPES,
    ColumnSpec,
    DatasetSpec,
    TableSpec,
    ValueRule,
    rule_problems,
)

INDEX = "row_idx"
ROWS_PER_TASK = 10_000_000


def row_index(
    spark: SparkSession, rows: int, offset: int = 0, limit: int | None = None, partitions: int | None = None
) -> DataFrame:
    """The positions ``[offset, min(offset + limit, rows))``."""
    end = rows if limit is None else min(offset + limit, rows)
    if partitions is None:
        partitions = max(spark.sparkContext.defaultParallelism, -(-(end - offset) // ROWS_PER_TASK))
    return spark.range(offset, max(end, offset), 1, partitions).withColumnRenamed("id", INDEX)


def key_base(table: str, seed: int) -> int:
    """First surrogate key of a generated table."""
    return seed + rng.salts(0, table)[0] % 100_000


def surrogate_key(table: str, seed: int, index: str) -> Column:
    return F.expr(index) + F.lit(key_base(table, seed))


def rule_value(rule: ValueRule, seed: int, tag: str, index: str, locale: str = "en_US") -> Column:
    """Column expression of a generation rule."""
    problems = rule_problems(rule)
    if problems:
        raise ValueError(f"{tag}: {'; '.join(problems)}")
    params = rule.params
    if rule.kind == "faker":
        value = providers.provide(params["provider"], providers.Draws(seed, tag, index, locale))
    elif rule.kind == "uuid":
        value = providers.uuid(providers.Draws(seed, tag, index))
    elif rule.kind == "sequence":
        value = F.lit(int(params.get("start", 1))) + F.expr(index) * F.lit(int(params.get("step", 1)))
    elif rule.kind == "static":
        value = F.lit(params["value"])
    elif rule.kind == "range":
        value = _between(seed, tag, index, params.get("min"), params.get("max"))
    else:
        value = rng.choose_weighted(seed, tag, index, list(params["choices"]), params.get("weights"))
    chance = params.get("null_probability")
    if chance:
        value = F.when(~rng.below(chance, seed, tag + ".null", index), value)
    return value


def _between(seed: int, tag: str, index: str, low: float | None, high: float | None) -> Column:
    low = 0.0 if low is None else float(low)
    high = 100.0 if high is None else float(high)
    if low == high:
        return F.lit(low)
    if low.is_integer() and high.is_integer():
        return rng.randint(seed, tag, index, int(low), int(high))
    return _decimals(rng.uniform(seed, tag, index), low, high, 4)


def _decimals(u: Column, low: float, high: float, digits: int) -> Column:
    return floor_to(F.lit(low) + u * F.lit(high - low), digits)


def typed_value(column: ColumnSpec, seed: int, tag: str, index: str, locale: str = "en_US") -> Column:
    """Default value of a column from its hint or logical type."""
    draws = providers.Draws(seed, tag, index, locale)
    hint = (column.hint or "").lower()
    if hint in ("date", "created_at", "updated_at"):
        return _date(draws)
    if hint not in ("url", "word") and providers.known(hint):
        return providers.provide(hint, draws)

    kind = column.type
    if kind in ("integer", "bigint"):
        low = 0 if column.min_value is None else int(column.min_value)
        high = 2**31 - 1 if column.max_value is None else int(column.max_value)
        return draws.integer(low, high)
    if kind in ("float", "decimal"):
        low = 0.0 if column.min_value is None else float(column.min_value)
        high = 1.0 if column.max_value is None else float(column.max_value)
        return _decimals(draws.uniform(), low, high, 4)
    if kind == "currency":
        return _decimals(draws.uniform(), float(column.min_value or 0), float(column.max_value or 10_000), 2)
    if kind == "percent":
        return _decimals(draws.uniform(), 0.0, 1.0, 4)
    if kind == "boolean":
        return rng.below(0.5, seed, tag, index)
    if kind == "date":
        return _date(draws)
    if kind in ("datetime", "timestamp"):
        return F.to_timestamp_ntz(F.lit("2020-01-01 00:00:00")) + F.make_dt_interval(
            days=draws.integer(0, 1825, "day").cast("int"), secs=draws.integer(0, 86_400, "second").cast("decimal(12,6)")
        )
    if kind in ("uuid", "email", "phone", "url"):
        return providers.provide(kind, draws)
    if kind == "enum" and column.enum:
        return draws.pick(list(column.enum))
    if kind == "json":
        return F.to_json(F.struct(draws.integer(1, 99_999).alias("_placeholder")))
    return _text(column, draws, index)


def _date(draws: providers.Draws) -> Column:
    return F.date_add(F.lit("2020-01-01").cast("date"), draws.integer(0, 1825, "day").cast("int"))


#: Length of a text column that declares none.
DEFAULT_TEXT = 255


def _text(column: ColumnSpec, draws: providers.Draws, index: str) -> Column:
    longest = column.max_length or DEFAULT_TEXT
    if column.unique:
        value = F.concat_ws(
            "_", draws.pick(providers.WORDS, "word"), F.expr(index).cast("string"),
            draws.integer(0, 999_999, "suffix").cast("string"),
        )
        return F.substring(value, 1, longest)
    shortest = column.min_length or 1
    length = F.greatest(F.lit(5), draws.integer(min(shortest, longest), longest, "length"))
    words = F.concat_ws(" ", *[draws.pick(providers.WORDS, f"word{i}") for i in range(4)])
    filler = F.concat(words, F.lit(". "))
    # Rounded up, so that any length is filled.
    times = (length / F.length(filler)).cast("int") + 1
    return F.substring(F.repeat(filler, times), F.lit(1), F.least(length, F.lit(longest)).cast("int"))


def column_value(table: TableSpec, column: ColumnSpec, seed: int, index: str, locale: str) -> Column:
    tag = f"{table.name}.{column.name}"
    if column.name in table.primary_key and column.rule is None:
        value = surrogate_key(table.name, seed, index)
        return value.cast("string") if LOGICAL_TYPES[column.type].simpleString() == "string" else value
    if column.rule is not None:
        value = rule_value(column.rule, seed, tag, index, locale)
    else:
        value = typed_value(column, seed, tag, index, locale)
    if column.shape is not None:
        value = apply_shape(value, column.type, column.shape, seed, tag + ".shape", index)
    return value


def generate_rows(
    indexed: DataFrame, table: TableSpec, seed: int, locale: str = "en_US", keep_index: bool = True,
    index: str = INDEX,
) -> DataFrame:
    """Project every column of the spec over a frame that holds the row index."""
    columns = [
        column_value(table, c, seed, index, locale).cast(LOGICAL_TYPES[c.type]).alias(c.name)
        for c in table.columns
    ]
    return indexed.select(*([F.expr(index).alias(INDEX)] if keep_index else []), *columns)


def generate_table(
    spark: SparkSession, table: TableSpec, rows: int, seed: int, offset: int = 0, limit: int | None = None,
    locale: str = "en_US", keep_index: bool = False,
) -> DataFrame:
    """A table, or the slice of it that starts at ``offset``."""
    return generate_rows(row_index(spark, rows, offset, limit), table, seed, locale, keep_index)


def generate_dataset(
    spark: SparkSession, spec: DatasetSpec, scale: int, seed: int, only: Sequence[str] | None = None,
    counts: Mapping[str, int] | None = None, locale: str = "en_US", planner: str | RowPlanner = "by_name",
) -> dict[str, DataFrame]:
    """All tables of a dataset with foreign keys resolved.

    How many rows a table gets is up to ``counts`` or else to the planner, a registered name or any row planner.

    Generated parents have keys ``base + i``, so a child's key is arithmetic and no
    join is planned. Parents keyed by a rule are evaluated at the parent's row.
    """
    planned = dict(counts) if counts else planned_rows(planner, spec, scale, only)
    tables: dict[str, DataFrame] = {}
    for name in spec.load_order():
        if name not in planned:
            continue
        table = spec.table(name)
        rows = generate_table(spark, table, planned[name], seed, locale=locale, keep_index=True)
        for fk in spec.foreign_keys:
            parents = planned.get(fk.parent, 0)
            if fk.child != name or parents == 0:
                continue
            parent = spec.table(fk.parent)
            row = f"pmod({INDEX}, {parents}L)"
            for child_column, parent_column in zip(fk.child_columns, fk.parent_columns):
                value = column_value(parent, parent.column(parent_column), seed, row, locale)
                kind = LOGICAL_TYPES[table.column(child_column).type]
                rows = rows.withColumn(child_column, value.cast(kind))
        tables[name] = rows.drop(INDEX)
    return tables


#: How often a reference inside a reference is followed in sample records.
SAMPLE_DEPTH = 3


def json_records(index: Column, schema: Mapping[str, object], root: Mapping[str, object] | None = None, depth: int = SAMPLE_DEPTH) -> Column:
    """Sample JSON text for a JSON-schema-like description, driven by the row index.

    Supported: references into ``root`` (by default the schema itself), enum, string formats, integer, number, boolean, null, array,
    object. Recursive descriptions are followed ``depth`` references deep: below that a property is null and a list empty. A reference
    that leads nowhere raises an error.
    """
    return F.to_json(_sample(schema, index, root if root is not None else schema, depth), {"ignoreNullFields": "false"})


# Sample text per string format.
FORMAT_SAMPLES = {
    "uuid": "a1b2c3d4-e5f6-7890-abcd-ef1234567890",
    "date": "2024-01-15",
    "date-time": "2024-01-15T12:00:00Z",
    "email": "user@example.com",
}


def _sample(schema: Mapping[str, object], seed: Column, root: Mapping[str, object], depth: int) -> Column:
    while "$ref" in schema:
        if depth <= 0:
            return F.lit(None).cast("string")
        schema, depth = follow(root, str(schema["$ref"])), depth - 1
    options = schema.get("enum")
    if options:
        listed = F.array(*[F.lit(o) for o in options])
        return F.get(listed, F.pmod(seed, F.lit(len(options))).cast("int"))
    kind = schema.get("type", "string")
    if kind == "integer":
        return seed
    if kind == "number":
        return seed.cast("double")
    if kind == "boolean":
        return F.pmod(seed, F.lit(2)) == 0
    if kind == "null":
        return F.lit(None).cast("string")
    if kind == "array":
        item = schema.get("items") or {"type": "string"}
        if "$ref" in item and depth <= 0:
            return F.array().cast("array<string>")
        size = F.least(F.lit(2), F.pmod(seed, F.lit(3)) + 1).cast("int")
        return F.slice(F.array(_sample(item, seed, root, depth), _sample(item, seed + 1, root, depth)), F.lit(1), size)
    if kind == "object":
        properties = schema.get("properties") or {}
        return F.struct(
            *[_sample(p, seed + i * 7, root, depth).alias(name) for i, (name, p) in enumerate(properties.items())]
        )
    fixed = FORMAT_SAMPLES.get(str(schema.get("format", "")))
    return F.lit(fixed) if fixed else F.concat(F.lit("sample_"), seed.cast("string"))
