"""State machines over keyed events, told as data: fields, and rules with guards and effects.

A rule is tried in its place; the first that fits and does not go on decides. Guards look at the state, at the
event and at small tables keyed by a field of the state (`Lookup`); effects set fields. The same machine runs

* on a stream: a typed value state for each key (`run_stream`, transformWithStateInPandas),
* on a table: events sorted by key and order and read as they come (`run_batch`), so that no key is collected,

and says what it would do in SQL (`sql_outcomes`), for comparison. Each event gives one outcome: the rule, the
reply, the side outputs and the state after it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


class Is(NamedTuple):
    """field is one of values (None: null), or is not."""

    field: str
    values: tuple
    yes: bool = True


class Has(NamedTuple):
    """The array of an event holds a mark, or does not."""

    field: str
    mark: str
    yes: bool = True


class Differs(NamedTuple):
    """Both fields are told and differ."""

    field: str
    other: str


class Of(NamedTuple):
    """The value of a field of the event (as an effect)."""

    field: str


class Rule(NamedTuple):
    name: str
    #: Alternatives; each is a list of conditions that must all hold. An empty alternative always holds.
    guard: tuple[tuple, ...]
    effects: dict[str, Any] = {}
    reply: str = ""
    sides: tuple[str, ...] = ()
    goes_on: bool = False


class Lookup(NamedTuple):
    """A field by name: what a small table tells of another field; null is looked up as none."""

    name: str
    field: str
    table: dict
    none: Any
    unknown: Any


class Machine(NamedTuple):
    #: Names and types of the state, and its values before the first event.
    fields: dict[str, str]
    start: dict[str, Any]
    #: Columns of an event that rules look at.
    facts: tuple[str, ...]
    rules: tuple[Rule, ...]
    lookups: tuple[Lookup, ...] = ()


# ---------------------------------------------------------------- one event


def _holds(c, now: dict) -> bool:
    if isinstance(c, Is):
        return (now[c.field] in c.values) == c.yes
    if isinstance(c, Has):
        return (c.mark in (now[c.field] or ())) == c.yes
    return now[c.field] is not None and now[c.other] is not None and now[c.field] != now[c.other]


class Stepper:
    """step(state, facts) -> (rule, reply, sides, next state); what was asked once is remembered, up to a bound."""

    def __init__(self, machine: Machine, most: int = 100_000):
        self.machine, self.most, self.seen = machine, most, {}

    def _told(self, state: tuple, facts: tuple) -> tuple:
        m, sides = self.machine, []
        now = dict(zip(m.facts, facts)) | dict(zip(m.fields, state))
        for r in m.rules:
            for k in m.lookups:
                now[k.name] = k.none if now[k.field] is None else k.table.get(now[k.field], k.unknown)
            if not any(all(_holds(c, now) for c in way) for way in r.guard):
                continue
            sides += r.sides
            now |= {f: now[v.field] if isinstance(v, Of) else v for f, v in r.effects.items()}
            if not r.goes_on:
                return r.name, r.reply, tuple(sides), tuple(now[f] for f in m.fields)
        return "", "", tuple(sides), tuple(now[f] for f in m.fields)

    def step(self, state: tuple, facts: tuple) -> tuple:
        key = (state, facts)
        if key not in self.seen:
            if len(self.seen) >= self.most:
                self.seen.clear()
            self.seen[key] = self._told(state, facts)
        return self.seen[key]


def _plain(v):
    """A value of a pandas or Arrow row: arrays as tuples, what is missing as None."""
    if v is None or isinstance(v, (str, bool)):
        return v
    if hasattr(v, "__len__"):
        return tuple(v)
    return None if pd.isna(v) else v.item() if hasattr(v, "item") else v


def outcome_schema(events: DataFrame, key: str, order: list[str], machine: Machine) -> StructType:
    told = ", ".join(["rule string", "reply string", "sides array<string>", *(f"{f} {t}" for f, t in machine.fields.items())])
    out = StructType([events.schema[c] for c in (key, *order)])
    for f in StructType.fromDDL(told):
        out.add(f)
    return out


# ---------------------------------------------------------------- a table, a stream


def run_batch(events: DataFrame, key: str, order: list[str], machine: Machine) -> DataFrame:
    """key, order, rule, reply, sides and the state after each event. Events of a null key are one sequence."""
    schema = outcome_schema(events, key, order, machine)
    kinds = to_arrow_schema(schema)
    rows = events.select(key, *order, *machine.facts).repartition(key).sortWithinPartitions(key, *order)
    start = tuple(machine.start[f] for f in machine.fields)

    def run(batches):
        stepper, last, state = Stepper(machine), None, start
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in (key, *machine.facts)]
            told = []
            for k, *facts in zip(*cols):
                if last != (k,):
                    last, state = (k,), start
                rule, reply, sides, state = stepper.step(state, tuple(map(_plain, facts)))
                told.append((rule, reply, sides, *state))
            made = zip(*told) if told else [[] for _ in range(3 + len(machine.fields))]
            arrays = [pa.array(list(c), kinds.field(i + 1 + len(order)).type) for i, c in enumerate(made)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, *order)), *arrays], schema.names)

    return rows.mapInArrow(run, schema)


class _Keyed(StatefulProcessor):
    def __init__(self, key: str, order: list[str], machine: Machine, names: list[str]):
        self.key, self.order, self.machine, self.names = key, order, machine, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", ", ".join(f"{f} {t}" for f, t in self.machine.fields.items()))
        self.stepper = Stepper(self.machine)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        m = self.machine
        state = tuple(map(_plain, self.state.get())) if self.state.exists() else tuple(m.start[f] for f in m.fields)
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable")  # of one key in one micro-batch
        told = []
        for facts in zip(*(frame[c] for c in m.facts)):
            rule, reply, sides, state = self.stepper.step(state, tuple(map(_plain, facts)))
            told.append((rule, reply, list(sides), *state))
        self.state.update(state)
        out = pd.DataFrame(told, columns=self.names[1 + len(self.order) :]).astype(object)
        for c in reversed(self.order):
            out.insert(0, c, frame[c].to_numpy())
        out.insert(0, self.key, frame[self.key].to_numpy())
        yield out

    def close(self) -> None:
        pass


def run_stream(events: DataFrame, key: str, order: list[str], machine: Machine) -> DataFrame:
    """As run_batch, of a stream: events of a micro-batch are put in order, those of later ones come after. The state of
    each key is in RocksDB, the only store for typed state (the setting is the session's)."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = outcome_schema(events, key, order, machine)
    rows = events.select(key, *order, *machine.facts)
    return rows.groupBy(key).transformWithStateInPandas(_Keyed(key, order, machine, schema.names), schema, "append", "none")


def last_states(outcomes: DataFrame, key: str, order: list[str], machine: Machine) -> DataFrame:
    """The state of each key after its last event, and how many it had."""
    last = F.max_by(F.struct(*machine.fields), F.struct(*order))
    return outcomes.groupBy(key).agg(last.alias("_s"), F.count("*").alias("n_events")).select(key, "_s.*", "n_events")


def side_output(outcomes: DataFrame, side: str) -> DataFrame:
    """Outcomes that a side output takes."""
    return outcomes.where(F.array_contains("sides", side))


# ---------------------------------------------------------------- the same in SQL


def _literal(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def _condition_sql(c, m: Machine) -> str:
    ref = {k.name: "CASE WHEN {f} IS NULL THEN {n} {w} ELSE {u} END".format(
        f=k.field, n=_literal(k.none), u=_literal(k.unknown), w=" ".join(f"WHEN {k.field} = {_literal(a)} THEN {_literal(b)}" for a, b in k.table.items())) for k in m.lookups}
    x = f"({ref[c.field]})" if c.field in ref else c.field
    if isinstance(c, Has):
        return f"{'' if c.yes else 'NOT '}coalesce(list_contains({x}, {_literal(c.mark)}), false)"
    if isinstance(c, Differs):
        return f"coalesce({x} <> {c.other}, false)"
    some = [v for v in c.values if v is not None]
    ways = ([f"{x} IN ({', '.join(map(_literal, some))})"] if some else []) + ([f"{x} IS NULL"] if None in c.values else [])
    return f"{'' if c.yes else 'NOT '}coalesce({' OR '.join(ways)}, false)"


def _guard_sql(r: Rule, m: Machine) -> str:
    return "(" + " OR ".join("(" + (" AND ".join(_condition_sql(c, m) for c in way) or "true") + ")" for way in r.guard) + ")"


def _hit_sql(rules: list[Rule], m: Machine) -> str:
    return "CASE " + " ".join(f"WHEN {_guard_sql(r, m)} THEN '{r.name}'" for r in rules) + " END" if rules else "NULL"


def _effect_sql(field: str, rules: list[Rule], on: str) -> str:
    ways = [f"WHEN {on} = '{r.name}' THEN {v.field if isinstance(v, Of) else _literal(v)}" for r in rules if field in r.effects for v in [r.effects[field]]]
    return "CASE " + " ".join(ways) + f" ELSE {field} END" if ways else field


def sql_outcomes(events: str, key: str, order: list[str], m: Machine, kinds: dict[str, str]) -> str:
    """DuckDB SQL of run_batch over the query `events` (key, order, facts): a recursive walk, event by event. The name of a
    rule says what it does, so rules of one name must have the same effects."""
    segments: list[tuple[list[Rule], Rule | None]] = [([], None)]
    for r in m.rules:
        if r.goes_on:
            segments[-1] = (segments[-1][0], r)
            segments.append(([], None))
        else:
            segments[-1][0].append(r)
    inner = f"SELECT w.{', w.'.join(m.fields)}, e.*, CAST(NULL AS VARCHAR) AS hit, CAST([] AS VARCHAR[]) AS went FROM walk w JOIN e ON e.{key} IS NOT DISTINCT FROM w.{key} AND e.i = w.i + 1"
    for rules, through in segments:
        inner = f"SELECT * REPLACE (coalesce(hit, {_hit_sql(rules, m)}) AS hit) FROM ({inner})"
        if through:
            on = f"hit IS NULL AND {_guard_sql(through, m)}"
            sets = ", ".join(f"CASE WHEN {on} THEN {v.field if isinstance(v, Of) else _literal(v)} ELSE {f} END AS {f}" for f, v in through.effects.items())
            sides = f"CASE WHEN {on} THEN list_concat(went, {list(through.sides)}) ELSE went END AS went"
            inner = f"SELECT * REPLACE ({', '.join(filter(None, [sets, sides]))}) FROM ({inner})"
    stops = [r for rules, _ in segments for r in rules]
    sides = "CASE " + " ".join([f"WHEN hit = '{r.name}' THEN list_concat(went, {list(r.sides)})" for r in stops if r.sides] + ["WHEN false THEN went"]) + " ELSE went END"
    reply = "CASE " + " ".join(f"WHEN hit = '{r.name}' THEN {_literal(r.reply)}" for r in stops) + " ELSE '' END"
    after = ", ".join(f"{_effect_sql(f, stops, 'hit')} AS {f}" for f in m.fields)
    step = f"SELECT {key}, i, {', '.join(order)}, coalesce(hit, '') AS rule, {reply} AS reply, {sides} AS sides, {after} FROM ({inner})"
    empty = ", ".join(f"CAST(NULL AS {kinds[c]}) AS {c}" for c in order)
    first = ", ".join(f"CAST({_literal(m.start[f])} AS {'VARCHAR' if t == 'string' else t}) AS {f}" for f, t in m.fields.items())
    return f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {', '.join(order)}) AS i FROM ({events})),
walk AS (
  SELECT DISTINCT {key}, CAST(0 AS BIGINT) AS i, {empty}, '' AS rule, '' AS reply, CAST([] AS VARCHAR[]) AS sides, {first} FROM e
  UNION ALL
  {step})
SELECT {key}, {', '.join(order)}, rule, reply, array_to_string(sides, ',') AS sides, {', '.join(m.fields)} FROM walk WHERE i > 0"""
