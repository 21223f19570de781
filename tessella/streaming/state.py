"""Keyed state on event streams, each with a batch twin that folds the ordered events of a key.

Streaming: `stream_*` take a streaming DataFrame and return one. Batch twins are plain DataFrame
operators, used for replays and to test the streaming form.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# ---------------------------------------------------------------- rule-table state machine

#: A rule: (control word or *, state or *, next state or =); the first that fits decides.
Rule = tuple[str, str, str]


def next_state(rules: list[Rule], state: str, control: str) -> str:
    for word, where, then in rules:
        if word in ("*", control) and where in ("*", state):
            return state if then == "=" else then
    return state


def step_expression(rules: list[Rule]) -> Callable[[Column, Column], Column]:
    """The same as a Column of (state, control)."""

    def step(state: Column, control: Column) -> Column:
        out = state
        for word, where, then in reversed(rules):
            fits = F.lit(True)
            if word != "*":
                fits = fits & (control == word)
            if where != "*":
                fits = fits & (state == where)
            out = F.when(fits, state if then == "=" else F.lit(then)).otherwise(out)
        return out

    return step


def batch_states(events: DataFrame, key: str, order: list[str], control: str, rules: list[Rule], start: str) -> DataFrame:
    """key, state after all events, number of events: a fold over the events of each key in order."""
    step = step_expression(rules)
    g = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(control).alias("_c")))).alias("_e"))
    return g.select(key, F.aggregate("_e", F.lit(start), lambda s, e: step(s, F.coalesce(e["_c"], F.lit("")))).alias("state"), F.size("_e").cast("long").alias("n_events"))


def stream_states(events: DataFrame, key: str, order: str, control: str, rules: list[Rule], start: str) -> DataFrame:
    """As batch_states, kept up as events come; a row for each key of a micro-batch."""
    kind = events.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, n = state.get if state.exists else (start, 0)
        for pdf in [pd.concat(list(frames)).sort_values(order, kind="stable")]:
            for c in pdf[control]:
                now = next_state(rules, now, c if isinstance(c, str) else "")
                n += 1
        state.update((now, n))
        yield pd.DataFrame({key: [k[0]], "state": [now], "n_events": [n]})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, state string, n_events long", "state string, n long", "update", GroupStateTimeout.NoTimeout)


#: Conversation control: later rules are general. Words are the normalised message or button.
CONVERSATION: list[Rule] = [
    ("stop", "*", "awaiting_consent"), ("back_to_language", "*", "awaiting_language"), ("language", "*", "awaiting_language"),
    ("start", "*", "awaiting_language"), ("fr", "awaiting_language", "awaiting_consent"), ("ar", "awaiting_language", "awaiting_consent"),
    ("es", "awaiting_language", "awaiting_consent"), ("ru", "awaiting_language", "awaiting_consent"), ("*", "awaiting_language", "="),
    ("accept", "awaiting_consent", "carousel"), ("decline", "awaiting_consent", "="), ("*", "awaiting_consent", "="),
    ("menu", "*", "carousel"), ("profile", "*", "="), ("help", "*", "="), ("back", "free_question", "theme_menu"), ("back", "*", "carousel"),
    ("auth_ok", "*", "theme_menu"), ("theme", "*", "theme_menu"), ("ask", "theme_menu", "free_question"), ("product", "theme_menu", "product_search"),
    ("interaction", "theme_menu", "interaction_check"), ("*", "carousel", "="), ("*", "free_question", "="), ("*", "theme_menu", "="),
]


# ---------------------------------------------------------------- delivery status


def delivery_status(reported: Column) -> Column:
    return F.when(reported == "delivered", "delivered").when(reported == "failed", "failed").otherwise("sent")


def last_status(callbacks: DataFrame, key: str, order: list[str], reported: str, monotonic: bool = False) -> DataFrame:
    """key, status: the last report decides; monotonic: delivered and failed are not taken back."""
    status = delivery_status(F.col(reported))
    if not monotonic:
        return callbacks.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias("status"))
    final = F.when(status != "sent", status)
    return callbacks.groupBy(key).agg(F.coalesce(F.max_by(final, F.when(final.isNotNull(), F.struct(*order))), F.lit("sent")).alias("status"))


def stream_into_table(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Run a merge function on each micro-batch until what is there has been read."""
    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


# ---------------------------------------------------------------- rate limit


def rate_limit(events: DataFrame, key: str, at: str, order: list[str], seconds: int = 60, most: int = 20) -> DataFrame:
    """key, order columns, window_start, window_count, allowed. A window opens with the first event of a key after
    the last one has passed; at most `most` events of a window are allowed. An event without a time is a window of
    its own. Events are sorted by key and time and read as they come, so a key's events are never held together."""
    span = seconds * 1_000_000
    rows = events.select(key, *order, F.unix_micros(F.col(at).cast("timestamp")).alias("_t")).repartition(key).sortWithinPartitions(key, "_t", *order)

    def run(batches):
        last, start, n = None, None, 0  # the key so far, its window and the events in that
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, times = batch.column(key), batch.column("_t")
            code = np.asarray(keys.dictionary_encode("encode").indices)
            known, t = np.asarray(times.is_valid()), np.asarray(times.fill_null(0))
            starts, counts = t.copy(), np.ones(len(t), np.int32)
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]).tolist()
            for a, b in zip(first, [*first[1:], len(t)]):
                if last != (own := (keys[a].as_py(),)):
                    last, start, n = own, None, 0
                a += int((~known[a:b]).sum())  # they stand first
                while a < b:
                    if start is None or t[a] - start > span:
                        start, n = int(t[a]), 0
                    c = int(np.searchsorted(t[a:b], start + span, "right"))
                    starts[a : a + c], counts[a : a + c] = start, n + 1 + np.arange(c)
                    n, a = n + c, a + c
            told = [pa.array(starts, mask=~known), pa.array(counts), pa.array(counts <= most)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, *order)), *told], [key, *order, "window_start", "window_count", "allowed"])

    out = rows.drop("_t").withColumns({"window_start": F.lit(0).cast("long"), "window_count": F.lit(0), "allowed": F.lit(True)})
    kind = events.schema[at].dataType
    return rows.mapInArrow(run, out.schema).withColumn("window_start", F.timestamp_micros("window_start").cast(kind))


# ---------------------------------------------------------------- ingestion and consent


def stream_new(events: DataFrame, keys: list[str], at: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each event once; with an event time, what is remembered is bounded by the delay."""
    if at is None:
        return events.dropDuplicates(keys)
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def gate(events: DataFrame, consents: DataFrame, key: str, refused: list[str]) -> DataFrame:
    """Events of keys that have not refused (stream or batch against a table)."""
    return events.join(consents.where(F.col("consent_status").isin(refused)).select(key), key, "left_anti")


def opt_out(preferences: DataFrame, stops: DataFrame, key: str, at: str) -> tuple[DataFrame, DataFrame]:
    """(preferences with those of stopped keys opted out, a history row for each change)."""
    gone = stops.select(key).distinct().withColumn("_stop", F.lit(True))
    both = preferences.join(gone, key, "left")
    hit = F.coalesce(F.col("_stop"), F.lit(False)) & (F.col("status") != "opted_out")
    changed = both.where(hit).select(*[c for c in preferences.columns if c != "status"], F.lit("opted_out").alias("status"), F.lit(at).cast("timestamp").alias("changed_at"))
    return both.withColumn("status", F.when(hit, "opted_out").otherwise(F.col("status"))).drop("_stop"), changed


CONSENT: list[Rule] = [("accept", "*", "accepted"), ("refuse", "*", "refused"), ("revoke", "accepted", "revoked"), ("reprompt", "accepted", "pending"), ("*", "*", "=")]


def needs_prompt(consents: DataFrame, version: str) -> DataFrame:
    """Consents given for another version than the current one."""
    return consents.where((F.col("consent_status") == "accepted") & F.col("consent_version").isNotNull() & (F.col("consent_version") != version))


def sessions_per_key(events: DataFrame, key: str, at: str, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(key, F.session_window(at, gap)).agg(F.count("*").alias("n"))


def turn_states(turns: DataFrame, by: str, order: str, marker: Column, value: Column, out: str = "state") -> DataFrame:
    """Last value told up to each turn."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn(out, F.last(F.when(marker, value), ignorenulls=True).over(w))
