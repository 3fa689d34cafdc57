"""Conformance of JSON records to a contract."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a parsed value of each contract type may look like.
TYPE_PATTERNS = {
    "integer": "^BIGINT$",
    "number": "^(BIGINT|DOUBLE|DECIMAL.*)$",
    "string": "^STRING$",
    "boolean": "^BOOLEAN$",
    "null": "^VOID$",
    "array": "^ARRAY<",
    "object": "^OBJECT<",
}


# Text formats a contract may ask for.
FORMATS = {
    "date": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$",
    "date-time": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[Tt ]([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?([Zz]|[+-]\d{2}:\d{2})?$",
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "uuid": r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.\-]*:\S+$",
}


@dataclass(frozen=True)
class Contract:
    """Required property names and, where given, types, allowed values, text formats, types of an array's items,
    and contracts of nested objects. What a contract doesn't name is allowed."""

    name: str
    required: Sequence[str] = ()
    types: Mapping[str, str] = field(default_factory=dict)
    enums: Mapping[str, Sequence[object]] = field(default_factory=dict)
    formats: Mapping[str, str] = field(default_factory=dict)
    items: Mapping[str, str] = field(default_factory=dict)
    nested: Mapping[str, Contract] = field(default_factory=dict)


def _path(name: str) -> str:
    """A property by its exact name, dots and all."""
    return f'["{name}"]' if "'" in name else f"['{name}']"


def _checks(contract: Contract, value: Column, shown: str, is_object: Column) -> Iterator[Column]:
    """Reasons why a parsed object breaks the contract; null where it doesn't."""

    def part(name: str) -> Column:
        return F.try_variant_get(value, "$" + _path(name), "variant")

    for name in contract.required:
        yield F.when(is_object & part(name).isNull(), F.lit(f"missing required property: {shown}{name}"))
    for name, kind in contract.types.items():
        wrong = is_object & ~F.schema_of_variant(part(name)).rlike(TYPE_PATTERNS[kind])
        yield F.when(wrong, F.lit(f"property {shown}{name} is not {kind}"))
    for name, allowed in contract.enums.items():
        texts = [json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in allowed]
        wrong = is_object & ~F.to_json(part(name)).isin(texts)
        yield F.when(wrong, F.lit(f"property {shown}{name} is none of the allowed values"))
    for name, kind in contract.formats.items():
        text = F.when(F.schema_of_variant(part(name)) == "STRING", F.try_variant_get(value, "$" + _path(name), "string"))
        yield F.when(is_object & ~text.rlike(FORMATS[kind]), F.lit(f"property {shown}{name} is no {kind}"))
    for name, kind in contract.items.items():
        shape = F.schema_of_variant(part(name))
        inner = F.substr(shape, F.lit(7), F.length(shape) - 7)
        wrong = is_object & shape.startswith("ARRAY<") & (inner != "VOID") & ~inner.rlike(TYPE_PATTERNS[kind])
        yield F.when(wrong, F.lit(f"items of {shown}{name} are not all {kind}"))
    for name, inner in contract.nested.items():
        yield from _checks(inner, part(name), f"{shown}{name}.", F.schema_of_variant(part(name)).startswith("OBJECT<"))


def check_records(df: DataFrame, record: str, contract: Contract) -> DataFrame:
    """Add ``passed`` and ``reason`` (null when passed).

    Parsing and reasons are separate projections, so every record is parsed once.
    """
    # Inside brackets, so that anything after the record's end makes it invalid.
    wrapped = F.try_parse_json(F.concat(F.lit("["), F.col(record), F.lit("]")))
    first = F.try_variant_get("_wrapped", "$[0]", "variant")
    second = F.try_variant_get("_wrapped", "$[1]", "variant")
    parsed = df.withColumn("_wrapped", wrapped).withColumn("_parsed", F.when(second.isNull(), first))
    shaped = parsed.withColumn("_object", F.schema_of_variant("_parsed").startswith("OBJECT<"))
    is_object = F.coalesce(F.col("_object"), F.lit(False))
    checks = [
        F.when(F.col("_parsed").isNull(), F.lit("Invalid JSON")),
        F.when(F.col("_parsed").isNotNull() & ~is_object, F.lit("Expected object")),
        *_checks(contract, F.col("_parsed"), "", is_object),
    ]
    reason = F.nullif(F.concat_ws("; ", *checks), F.lit(""))
    return shaped.withColumn("reason", reason).select(
        *df.columns, F.col("reason").isNull().alias("passed"), "reason"
    )


def contract_totals(checked: DataFrame, contract: Contract) -> DataFrame:
    return checked.agg(
        F.lit(contract.name).alias("contract"),
        F.count(F.lit(1)).alias("total"),
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
    )
