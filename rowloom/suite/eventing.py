"""Event streams, late data, notes and JSON contracts on the given events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import fixed_values as fixed
from rowloom.functions import rng
from rowloom.operators import contracts, events, json_schema
from rowloom.operators.selection import exact_share
from rowloom.suite import duck
from rowloom.suite.registry import query, table

SEED = 42
KEY = "event_id"
START = "2024-03-01 00:00:00"
SPAN = 30 * 86_400 * 1_000_000
COUNT = "(SELECT count(*) FROM events)"


def _positions(spark: SparkSession, folder: str) -> DataFrame:
    """Event ids are the positions in the stream to be made."""
    return table(spark, folder, "events").select(KEY)


def _offset_sql(pattern: str, at: str = KEY) -> str:
    u, span = duck.uniform(SEED, f"time.{pattern}", at), f"{float(SPAN)!r}::DOUBLE"
    share = f"({at}::DOUBLE / {COUNT}::DOUBLE)"
    return {
        "steady": f"floor({span} * {u})",
        "burst": f"floor(CASE WHEN {at} < {COUNT} - floor({COUNT} * 0.3::DOUBLE) THEN {span} * {u} "
                 f"ELSE {span} * 0.9::DOUBLE + {span} * 0.1::DOUBLE * {u} END)",
        "seasonal": f"floor(least({span}, greatest(0.0::DOUBLE, {span} * {share} + {span} * 0.05::DOUBLE * "
                    f"({u} - 0.5::DOUBLE) * CASE WHEN floor({share} * 4.0::DOUBLE)::INTEGER % 2 = 0 THEN 1.0::DOUBLE "
                    f"ELSE 0.65::DOUBLE END)))",
        "growth": f"floor({span} * least(1.0::DOUBLE, sqrt(({at}::DOUBLE + {u}) / {COUNT}::DOUBLE)))",
    }[pattern]


def _time_sql(pattern: str, at: str = KEY) -> str:
    return f"TIMESTAMP '{START}' + to_microseconds({_offset_sql(pattern, at)}::BIGINT)"


def _pattern(pattern: str) -> None:
    @query(f"ts_{pattern}", f"SELECT event_id, {_time_sql(pattern)} AS ts FROM events")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        positions = _positions(spark, folder)
        return events.event_times(positions, KEY, positions.count(), pattern, START, SPAN, SEED)


for _name in ("steady", "burst", "seasonal", "growth"):
    _pattern(_name)


def _made_sql(domain: str, pattern: str) -> str:
    kinds = duck.choose(SEED, "event.type", "event_no", fixed.EVENT_TYPES[domain])
    entity = duck.draw(SEED, "event.entity", "event_no")
    return f"""SELECT event_no, 'evt_' || lpad(event_no::VARCHAR, 8, '0') AS event_id, ts, {kinds} AS event_type,
      'entity_' || ((({entity} * greatest(1, {COUNT} // 10)) >> 32) + 1) AS entity_id
      FROM (SELECT ts, row_number() OVER (ORDER BY ts, pos) - 1 AS event_no
            FROM (SELECT event_id AS pos, {_time_sql(pattern)} AS ts FROM events))"""


def made_events(spark: SparkSession, folder: str, domain: str = "saas_billing", pattern: str = "growth") -> DataFrame:
    positions = _positions(spark, folder)
    return events.generate_events(positions, KEY, positions.count(), domain, pattern, START, SPAN, SEED)


@query("gen_events", _made_sql("ecommerce", "burst"))
def gen_events(spark: SparkSession, folder: str) -> DataFrame:
    return made_events(spark, folder, "ecommerce", "burst")


MADE = _made_sql("saas_billing", "growth")


@query("gen_events_rising", MADE)
def gen_events_rising(spark: SparkSession, folder: str) -> DataFrame:
    return made_events(spark, folder)


LATE = f"{duck.uniform(SEED, 'late.pick', KEY)} < 0.15::DOUBLE"
LATE_SQL = f"""SELECT event_id, user_id, event_type, value, props,
    CASE WHEN {LATE} THEN ts + to_milliseconds({duck.randint(SEED, 'late.delay', KEY, 60_000, 3_600_000)}) ELSE ts END AS ts,
    {LATE} AS late_arrival, CASE WHEN {LATE} THEN ts END AS event_ts_original FROM events"""


@query("late_arrivals", LATE_SQL)
def late_arrivals(spark: SparkSession, folder: str) -> DataFrame:
    return events.late_arrivals(table(spark, folder, "events"), KEY, 0.15, SEED)


def _replay(mode: str, order: str) -> None:
    oracle = f"SELECT event_id, ts, row_number() OVER (ORDER BY {order}) - 1 AS arrival_seq FROM events"

    @query("replay_order" if mode == "shuffled" else f"replay_order_{mode}", oracle)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        found = table(spark, folder, "events").select(KEY, "ts")
        return events.replay_order(found, KEY, found.count(), mode, SEED)


_replay("ordered", KEY)
_replay("shuffled", f"{duck.draw(SEED, 'replay.shuffled', KEY)}, {KEY}")
_replay("windowed", f"{KEY} // greatest(1, {COUNT} // 5), {duck.draw(SEED, 'replay.windowed', KEY)}, {KEY}")


# Notes for a fifth of the generated events

NOTED = f"""made AS ({MADE}), noted AS (SELECT 'ticket_' || lpad(event_no::VARCHAR, 7, '0') AS ticket_id, entity_id,
      event_id AS linked_event_id, event_type, ts,
      replace(replace({duck.choose(SEED, 'note.template', 'event_no', fixed.NOTE_TEMPLATES)}, '{{event_type}}', event_type),
        '{{entity_id}}', entity_id) AS note,
      {duck.choose(SEED, 'note.severity', 'event_no', fixed.SEVERITIES)} AS severity
      FROM (SELECT *, row_number() OVER (ORDER BY {duck.draw(SEED, 'note.pick', 'event_no')}, event_no) AS r FROM made)
      WHERE r <= greatest(1, floor({COUNT} * 0.2::DOUBLE)))"""


def _noted(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    made = made_events(spark, folder)
    chosen = exact_share(made, 0.2, SEED, "note.pick", "event_no")
    return made, events.support_notes(made, "event_no", chosen, SEED)


@query("gen_notes", f"WITH {NOTED} SELECT * FROM noted")
def gen_notes(spark: SparkSession, folder: str) -> DataFrame:
    return _noted(spark, folder)[1]


# Some notes point nowhere or at nothing

LOST = duck.uniform(SEED, "note.lost", "substr(ticket_id, 8)::BIGINT")
LINKED = f"""WITH {NOTED}, linked AS (SELECT * REPLACE (CASE WHEN {LOST} < 0.1::DOUBLE THEN 'gone_' || ticket_id
      WHEN {LOST} >= 0.95::DOUBLE THEN '' ELSE linked_event_id END AS linked_event_id) FROM noted)"""


def _linked(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    made, notes = _noted(spark, folder)
    lost = rng.uniform(SEED, "note.lost", "substring(ticket_id, 8)")
    broken = (
        F.when(lost < 0.1, F.concat(F.lit("gone_"), "ticket_id")).when(lost >= 0.95, "").otherwise(F.col("linked_event_id"))
    )
    return made, notes.withColumn("linked_event_id", broken)


@query(
    "link_report",
    f"""{LINKED}, d AS (SELECT linked_event_id, linked_event_id IN (SELECT event_id FROM made) AS hit, count(*) AS n
      FROM linked GROUP BY 1)
    SELECT {COUNT} AS total_events, sum(n)::BIGINT AS linked_notes, count(*) FILTER (hit) AS linked_event_count,
    count(*) FILTER (NOT hit AND linked_event_id <> '') AS orphan_link_count,
    floor((count(*) FILTER (hit))::DOUBLE / greatest(1, {COUNT})::DOUBLE * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE
      AS coverage_ratio FROM d""",
)
def link_report(spark: SparkSession, folder: str) -> DataFrame:
    return events.link_totals(*_linked(spark, folder))


@query(
    "link_orphans",
    f"""{LINKED} SELECT DISTINCT linked_event_id FROM linked WHERE linked_event_id <> ''
    AND linked_event_id NOT IN (SELECT event_id FROM made)""",
)
def link_orphans(spark: SparkSession, folder: str) -> DataFrame:
    return events.orphan_links(*_linked(spark, folder))


@query(
    "link_breakdown",
    f"""{LINKED} SELECT 'severity' AS dimension, severity AS label, count(*) AS notes FROM linked GROUP BY 2
    UNION ALL SELECT 'event_type', event_type, count(*) FROM linked GROUP BY 2""",
)
def link_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return events.link_breakdown(_linked(spark, folder)[1])


WINDOWS = """SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type,
    count(*) AS events, sum(value::DECIMAL(28,6))::DOUBLE AS value_sum FROM events GROUP BY ALL"""


@query("event_windows", WINDOWS)
def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    return events.event_windows(table(spark, folder, "events"), "1 day", ["event_type"], "value")


# Sessions by gaps: an event opens one where the user's event before is more than the gap away

SESSION_GAP = "30 minutes"
SESSIONS = """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
    SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS events,
    sum(value::DECIMAL(28,6))::DOUBLE AS value_sum FROM n GROUP BY user_id, session"""


@query("event_sessions", SESSIONS)
def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return events.event_sessions(table(spark, folder, "events"), SESSION_GAP, ["user_id"], "value")


@query(
    "late_report",
    f"""SELECT date_trunc('hour', coalesce(event_ts_original, ts)) AS window_start, count(*) AS events,
    count(*) FILTER (late_arrival) AS late_events,
    count(*) FILTER (late_arrival AND ts - event_ts_original > INTERVAL 30 MINUTE) AS beyond_allowed
    FROM ({LATE_SQL}) GROUP BY 1""",
)
def late_report(spark: SparkSession, folder: str) -> DataFrame:
    late = events.late_arrivals(table(spark, folder, "events"), KEY, 0.15, SEED)
    return events.late_report(late, "1 hour", "30 MINUTES")


# Contracts: errors lack the property, clicks are arrays, signups are cut off, purchases hold text

CONTRACT = contracts.Contract("event_props", required=("k",), types={"k": "integer", "note": "string"})
RECORD = """CASE event_type WHEN 'error' THEN '{"other":1}' WHEN 'click' THEN '[1]' WHEN 'signup' THEN substring(props, 2)
    WHEN 'purchase' THEN '{"k":"text","note":7}' ELSE props END"""
REASON = """CASE event_type WHEN 'error' THEN 'missing required property: k' WHEN 'click' THEN 'Expected object'
    WHEN 'signup' THEN 'Invalid JSON' WHEN 'purchase' THEN 'property k is not integer; property note is not string' END"""


def checked_records(found: DataFrame) -> DataFrame:
    records = found.select(KEY, F.expr(RECORD).alias("record"))
    return contracts.check_records(records, "record", CONTRACT).select(KEY, "passed", "reason")


@query("json_contract", f"SELECT event_id, {REASON} IS NULL AS passed, {REASON} AS reason FROM events")
def json_contract(spark: SparkSession, folder: str) -> DataFrame:
    return checked_records(table(spark, folder, "events"))


@query(
    "json_contract_totals",
    f"""SELECT 'event_props' AS contract, count(*) AS total, count(*) FILTER ({REASON} IS NULL) AS passed,
    count(*) FILTER ({REASON} IS NOT NULL) AS failed FROM events""",
)
def json_contract_totals(spark: SparkSession, folder: str) -> DataFrame:
    return contracts.contract_totals(checked_records(table(spark, folder, "events")), CONTRACT)


# Contracts in depth: dates that can't be, items and nested properties of the wrong type, values outside the allowed ones

DEEP = contracts.Contract(
    "event_record", required=("at", "who"), formats={"at": "date"}, items={"tags": "string"},
    nested={"who": contracts.Contract("who", required=("id",), types={"id": "integer"}, enums={"kind": ("view", "click", "purchase")})},
)
DEEP_RECORD = """concat('{"at":"', IF(event_id % 7 = 0, '2024-13-01', '2024-01-05'), '","tags":', IF(event_id % 3 = 0, '[1]', '["x","y"]'),
    ',"who":{', CASE event_id % 5 WHEN 0 THEN '"id":"x",' WHEN 1 THEN '' ELSE concat('"id":', event_id, ',') END,
    '"kind":"', event_type, '"}}')"""
DEEP_REASON = """nullif(concat_ws('; ', CASE WHEN event_id % 7 = 0 THEN 'property at is no date' END,
    CASE WHEN event_id % 3 = 0 THEN 'items of tags are not all string' END,
    CASE event_id % 5 WHEN 1 THEN 'missing required property: who.id' WHEN 0 THEN 'property who.id is not integer' END,
    CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'property who.kind is none of the allowed values' END), '')"""


@query("json_contract_deep", f"SELECT event_id, {DEEP_REASON} IS NULL AS passed, {DEEP_REASON} AS reason FROM events")
def json_contract_deep(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "events").select(KEY, F.expr(DEEP_RECORD).alias("record"))
    return contracts.check_records(records, "record", DEEP).select(KEY, "passed", "reason")


# A schema document with nested arrays, references and alternatives; the records break it in known places

EVENT_SCHEMA = {
    "definitions": {
        "Amount": {"type": "number", "minimum": 0, "multipleOf": 0.01},
        "Line": {
            "type": "object", "required": ["sku", "amount"], "additionalProperties": False,
            "properties": {"sku": {"type": "string", "pattern": "^[a-z]+-[0-9]+$"}, "amount": {"$ref": "#/definitions/Amount"}, "note": {"type": ["string", "null"]}},
        },
        "Event": {
            "type": "object", "required": ["id", "lines"], "properties": {
                "id": {"type": "integer"}, "version": {"const": 2}, "by": {"oneOf": [{"type": "string", "maxLength": 5}, {"type": "integer"}]},
                "lines": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"$ref": "#/definitions/Line"}},
            },
        },
    },
}
EVENT_RECORD = """concat('{"id":', IF(event_id % 11 = 0, concat('"', event_id, '"'), CAST(event_id AS STRING)), ',"version":', IF(event_id % 13 = 0, 1, 2),
    ',"by":', IF(event_id % 17 = 0, '"longer"', IF(event_id % 2 = 0, '"user"', CAST(user_id AS STRING))), ',"lines":', CASE WHEN event_id % 19 = 0 THEN '[]'
    WHEN event_id % 5 = 0 THEN concat('[{"sku":"x-1","amount":1.5},{"sku":"', event_type, '","amount":', CAST(CAST(value AS DECIMAL(20,2)) AS STRING), '}]')
    WHEN event_id % 7 = 0 THEN '[{"sku":"a-1","amount":-1},{"amount":2,"more":true}]' WHEN event_id % 3 = 0 THEN '[{"sku":"a-1","amount":2},{"amount":2.0,"sku":"a-1"}]'
    ELSE concat('[{"sku":"a-', event_id, '","amount":', CAST(CAST(value AS DECIMAL(20,2)) AS STRING), ',"note":null}]') END, '}')"""
EVENT_FAULTS = """list_filter([CASE WHEN event_id % 11 = 0 THEN '$.id is not integer' END, CASE WHEN event_id % 13 = 0 THEN '$.version is not the given value' END,
    CASE WHEN event_id % 17 = 0 THEN '$.by doesn''t fit exactly one of the alternatives' END,
    CASE WHEN event_id % 19 = 0 THEN '$.lines has fewer than 1 items' WHEN event_id % 5 = 0 THEN '$.lines[1].sku doesn''t match ^[a-z]+-[0-9]+$'
      WHEN event_id % 7 = 0 THEN '$.lines[0].amount is less than 0; $.lines[1] lacks sku; $.lines[1].more is not allowed'
      WHEN event_id % 3 = 0 THEN '$.lines has items twice' END], lambda x: x IS NOT NULL)"""


@query(
    "json_schema",
    f"""SELECT event_id, len(f) = 0 AS passed, nullif(array_to_string(f, '; '), '') AS reason,
    CAST(len(string_split(array_to_string(f, '; '), '; ')) - CASE WHEN len(f) = 0 THEN 1 ELSE 0 END AS INT) AS errors
    FROM (SELECT event_id, {EVENT_FAULTS} AS f FROM events)""",
)
def json_schema_records(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "events").select(KEY, F.expr(EVENT_RECORD).alias("record"))
    return json_schema.check_schema(records, "record", EVENT_SCHEMA, "#/definitions/Event").select(KEY, "passed", "reason", "errors")
