"""JSON Schema documents compiled to column expressions.

A schema is compiled once, on the driver, to an expression that gives the list of what is wrong with a record; records are parsed
once and checked inside the JVM, on batches and streams alike. Arrays and the properties of objects are gone through
by higher-order functions, so a record may hold any number of them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.operators.contracts import FORMATS
from rowloom.plans.pointers import follow

#: References are followed so deep into a value; what a recursive schema says about deeper values can't be told.
MAX_DEPTH = 6

Schema = Mapping[str, object] | bool

# The keywords that are checked, by what they ask about.
ANY = {"type", "enum", "const"}
TEXT = {"minLength", "maxLength", "pattern", "format"}
NUMBER = {"minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"}
ARRAY = {"items", "prefixItems", "contains", "minItems", "maxItems", "uniqueItems"}
OBJECT = {"properties", "patternProperties", "additionalProperties", "propertyNames", "required", "dependentRequired", "minProperties", "maxProperties"}


class _Compiler:
    """Messages about a node: a struct of the value ``v``, its path ``p``, its members ``c`` or items ``i``, and its kind ``k``."""

    def __init__(self, root: Mapping[str, object], depth: int):
        self.root, self.depth = root, depth

    def errors(self, node: Column, schema: Schema, depth: int, passed: tuple[str, ...] = ()) -> Column:
        """A list of messages about a value that is there; empty where the schema holds."""
        if schema is True or schema == {}:
            return _none()
        if schema is False:
            return F.array(_at(node, "is not allowed"))
        ref = schema.get("$ref")
        found = []
        if ref is not None:
            if ref in passed:
                raise ValueError(f"{ref} refers to itself")
            if depth <= 0:
                found.append(F.array(_at(node, f"is nested deeper than {self.depth} references")))
            else:
                found.append(self.errors(node, follow(self.root, str(ref)), depth - 1, (*passed, str(ref))))
        # Columns are costly to make, so only those are made that a keyword asks for.
        checks = [c for keywords, of in ((ANY, self._any), (TEXT, self._text), (NUMBER, self._number)) if keywords & schema.keys() for c in of(node, schema)]
        if checks:
            found.append(F.array_compact(F.array(*checks)))
        found += self._array(node, schema, depth) if ARRAY & schema.keys() else []
        found += self._object(node, schema, depth) if OBJECT & schema.keys() else []
        found += self._branches(node, schema, depth, passed)
        return F.concat(*found) if found else _none()

    def each(self, values: Column, schema: Schema, depth: int) -> Column:
        """The messages about all of an array of ``v, p``. What a node is made of is computed once, however often it is asked for."""
        parts = F.transform(values, lambda x: F.struct(
            x["v"].alias("v"), x["p"].alias("p"), F.try_variant_get(x["v"], "$", "map<string,variant>").alias("c"),
            F.try_variant_get(x["v"], "$", "array<variant>").alias("i"),
        ))
        nodes = F.transform(parts, lambda x: F.struct(
            *[x[c].alias(c) for c in "vpci"],
            F.when(x["c"].isNotNull(), "OBJECT").when(x["i"].isNotNull(), "ARRAY").otherwise(F.schema_of_variant(x["v"])).alias("k"),
        ))
        return F.flatten(F.transform(nodes, lambda n: self.errors(n, schema, depth)))

    def one(self, value: Column, path: Column, schema: Schema, depth: int) -> Column:
        return self.each(F.array(F.struct(value.alias("v"), path.alias("p"))), schema, depth)

    def _any(self, node: Column, schema: Mapping[str, object]) -> list[Column]:
        made = []
        if "type" in schema:
            names = schema["type"] if isinstance(schema["type"], (list, tuple)) else [schema["type"]]
            fits = [_is(node, str(n)) for n in names]
            made.append(F.when(~_either(fits), _at(node, f"is not {' or '.join(map(str, names))}")))
        for keyword, allowed in (("enum", schema.get("enum")), ("const", [schema["const"]] if "const" in schema else None)):
            if allowed is not None:
                texts = [F.to_json(F.parse_json(F.lit(json.dumps(a, ensure_ascii=False)))) for a in allowed]
                shown = "is none of the allowed values" if keyword == "enum" else "is not the given value"
                made.append(F.when(~F.to_json(node["v"]).isin(texts), _at(node, shown)))
        return made

    def _text(self, node: Column, schema: Mapping[str, object]) -> list[Column]:
        text = F.when(node["k"] == "STRING", F.try_variant_get(node["v"], "$", "string"))
        tests = {
            "minLength": lambda n: (F.length(text) < n, f"is shorter than {n} characters"),
            "maxLength": lambda n: (F.length(text) > n, f"is longer than {n} characters"),
            "pattern": lambda p: (~text.rlike(p), f"doesn't match {p}"),
            "format": lambda f: (~text.rlike(FORMATS[f]), f"is no {f}") if f in FORMATS else None,
        }
        return _tested(schema, tests, node)

    def _number(self, node: Column, schema: Mapping[str, object]) -> list[Column]:
        def as_number(kind: str) -> Column:
            return F.when(_is(node, "number"), F.try_variant_get(node["v"], "$", kind))

        number = as_number("double")
        tests = {
            "minimum": lambda n: (number < n, f"is less than {n}"),
            "maximum": lambda n: (number > n, f"is more than {n}"),
            "exclusiveMinimum": lambda n: (number <= n, f"is not more than {n}"),
            "exclusiveMaximum": lambda n: (number >= n, f"is not less than {n}"),
            "multipleOf": lambda n: (as_number("decimal(38,12)") % F.lit(str(n)).cast("decimal(20,12)") != 0, f"is no multiple of {n}"),
        }
        return _tested(schema, tests, node)

    def _array(self, node: Column, schema: Mapping[str, object], depth: int) -> list[Column]:
        items = node["i"]
        tests = {
            "minItems": lambda n: (F.size(items) < n, f"has fewer than {n} items"),
            "maxItems": lambda n: (F.size(items) > n, f"has more than {n} items"),
            "uniqueItems": lambda on: (F.size(F.array_distinct(F.transform(items, lambda x: F.to_json(x)))) < F.size(items), "has items twice") if on else None,
        }
        tested = _tested(schema, tests, node)
        found = [F.array_compact(F.array(*[F.when(items.isNotNull(), c) for c in tested]))] if tested else []
        placed = F.transform(items, lambda x, i: F.struct(x.alias("v"), F.concat(node["p"], F.lit("["), i.cast("string"), F.lit("]")).alias("p")))
        if "contains" in schema:
            there = F.exists(placed, lambda x: F.size(self.one(x["v"], x["p"], schema["contains"], depth)) == 0)
            found.append(_listed(items.isNotNull() & ~there, _at(node, "contains no item that fits")))
        prefix = list(schema.get("prefixItems", ()))
        for i, own in enumerate(prefix):
            found.append(_if(F.size(items) > i, self.each(F.slice(placed, i + 1, 1), own, depth)))
        if schema.get("items", True) is not True:
            rest = F.slice(placed, len(prefix) + 1, 2**31 - 1 - len(prefix)) if prefix else placed
            found.append(_if(items.isNotNull(), self.each(rest, schema["items"], depth)))
        return found

    def _object(self, node: Column, schema: Mapping[str, object], depth: int) -> list[Column]:
        cells, is_object = node["c"], node["c"].isNotNull()

        def has(name: str) -> Column:
            return F.coalesce(F.map_contains_key(cells, F.lit(name)), F.lit(False))

        def below(name: Column) -> Column:
            return F.concat(node["p"], F.lit("."), name)

        def members(fits: Callable[[Column], Column], own: Schema) -> Column:
            chosen = F.filter(F.map_entries(cells), lambda e: fits(e["key"]))
            return _if(is_object, self.each(F.transform(chosen, lambda e: F.struct(e["value"].alias("v"), below(e["key"]).alias("p"))), own, depth))

        checks = [F.when(is_object & ~has(n), _at(node, f"lacks {n}")) for n in schema.get("required", ())]
        for name, others in dict(schema.get("dependentRequired", {})).items():
            checks += [F.when(has(name) & ~has(o), _at(node, f"lacks {o}, which goes with {name}")) for o in others]
        for keyword, sign in (("minProperties", "fewer"), ("maxProperties", "more")):
            if keyword in schema:
                n = schema[keyword]
                off = F.size(cells) < n if sign == "fewer" else F.size(cells) > n
                checks.append(F.when(is_object & off, _at(node, f"has {sign} than {n} properties")))
        found = [F.array_compact(F.array(*checks))] if checks else []
        known = dict(schema.get("properties", {}))
        for name, own in known.items():
            if own is not True and own != {}:
                found.append(_if(has(name), self.one(F.element_at(cells, F.lit(name)), below(F.lit(name)), own, depth)))
        patterns = dict(schema.get("patternProperties", {}))
        found += [members(_matching(pattern), own) for pattern, own in patterns.items()]
        rest = schema.get("additionalProperties", True)
        if rest is not True and rest != {}:
            named = [lambda k: k.isin(list(known)) if known else F.lit(False), *[_matching(p) for p in patterns]]
            found.append(members(lambda k: ~_either([fits(k) for fits in named]), rest))
        if "propertyNames" in schema:
            names = F.transform(F.map_keys(cells), lambda k: F.struct(F.parse_json(F.to_json(F.array(k))).alias("v"), below(k).alias("p")))
            found.append(_if(is_object, self.each(names, {"items": schema["propertyNames"]}, depth)))
        return found

    def _branches(self, node: Column, schema: Mapping[str, object], depth: int, passed: tuple[str, ...]) -> list[Column]:
        def fits(part: Schema) -> Column:
            return F.size(self.errors(node, part, depth, passed)) == 0

        found = [self.errors(node, part, depth, passed) for part in schema.get("allOf", ())]
        if "anyOf" in schema:
            found.append(_listed(~_either([fits(p) for p in schema["anyOf"]]), _at(node, "fits none of the alternatives")))
        if "oneOf" in schema:
            count = sum((fits(p).cast("int") for p in schema["oneOf"]), F.lit(0))
            found.append(_listed(count != 1, _at(node, "doesn't fit exactly one of the alternatives")))
        if "not" in schema:
            found.append(_listed(fits(schema["not"]), _at(node, "fits what is excluded")))
        if "if" in schema:
            then, other = (self.errors(node, schema.get(k, True), depth, passed) for k in ("then", "else"))
            found.append(F.when(fits(schema["if"]), then).otherwise(other))
        return found


def _none() -> Column:
    return F.array().cast("array<string>")


def _at(node: Column, problem: str) -> Column:
    return F.concat(node["p"], F.lit(f" {problem}"))


def _matching(pattern: str) -> Callable[[Column], Column]:
    return lambda key: key.rlike(pattern)


def _if(condition: Column, errors: Column) -> Column:
    return F.when(condition, errors).otherwise(_none())


def _listed(condition: Column, message: Column) -> Column:
    return _if(condition, F.array(message))


def _either(conditions: Sequence[Column]) -> Column:
    made = F.lit(False)
    for c in conditions:
        made = made | F.coalesce(c, F.lit(False))
    return made


def _tested(schema: Mapping[str, object], tests: Mapping[str, Callable[..., tuple[Column, str] | None]], node: Column) -> list[Column]:
    made = [test(schema[keyword]) for keyword, test in tests.items() if keyword in schema]
    return [F.when(wrong, _at(node, shown)) for wrong, shown in (m for m in made if m is not None)]


# How Spark names the types of values.
NUMBERS = "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"
KINDS = {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID", "array": "ARRAY", "object": "OBJECT"}


def _is(node: Column, name: str) -> Column:
    """Whether a value is of a JSON Schema type; a number without fraction is an integer too."""
    kind = node["k"]
    if name == "number":
        return kind.rlike(NUMBERS)
    if name == "integer":
        whole = F.try_variant_get(node["v"], "$", "double")
        return (kind == "BIGINT") | (kind.rlike(NUMBERS) & (F.floor(whole).cast("double") == whole))
    if name not in KINDS:
        raise ValueError(f"unknown type {name!r}")
    return kind == KINDS[name]


def check_schema(df: DataFrame, record: str, document: Mapping[str, object], pointer: str = "#", depth: int = MAX_DEPTH) -> DataFrame:
    """Add ``passed``, ``reason`` (null when passed) and ``errors``, the number of messages in it.

    ``pointer`` names the schema inside the document, such as ``#/components/schemas/Order``; references start at the document. Recursive
    schemas are followed ``depth`` references deep; a value below that is an error, so nothing unseen passes. A reference that
    leads to itself without going into a value raises an error, an unknown one too. A null record, text that isn't one JSON
    value and JSON followed by anything else are ``invalid JSON``. Unknown keywords and formats are ignored.
    """
    # Inside brackets, so that anything after the record's end makes it invalid.
    wrapped = F.try_parse_json(F.concat(F.lit("["), F.col(f"`{record}`"), F.lit("]")))
    parsed = F.try_variant_get(wrapped, "$", "array<variant>")
    compiled = _Compiler(document, depth)
    schema = follow(document, pointer)
    held = F.transform(F.array(parsed), lambda items: F.when(
        F.size(items) == 1, compiled.one(F.get(items, F.lit(0)), F.lit("$"), schema, depth)
    ).otherwise(F.array(F.lit("invalid JSON"))))
    listed = F.get(held, F.lit(0))
    return df.withColumn("_errors", listed).select(
        *[F.col(f"`{c}`") for c in df.columns],
        (F.size("_errors") == 0).alias("passed"),
        F.nullif(F.array_join("_errors", "; "), F.lit("")).alias("reason"),
        F.size("_errors").alias("errors"),
    )
