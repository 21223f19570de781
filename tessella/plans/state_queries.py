"""Conversation and consent as state machines over the events of users."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.sources.readers import table
from tessella.streaming import conversation as C
from tessella.streaming import machine as M

from .registry import query

TALK = (
    "hello there", "start", "FR", "accept", "menu", *(f"theme_{t.ident}" for t in C.TOPICS), "my question", "1", "2", "3", "6", "7", "8", "12", "harbour rules", "customs", "auth ok", "back",
    "es", " accept ", "decline", "full", "profile", "help", "card", "support", "support site", "form", "stop", "back_to_themes", "back_to_language", "/language", "theme_customs", "what is due", "accept",
)
MACHINE, LIFECYCLE = C.conversation(), C.consent_lifecycle()
_PICK, _VERSION, _ROLE = "(event_id * 7 + user_id * 13 + event_id // 41) % {n} + 1", "CASE WHEN event_id % 60 < 50 THEN 'v1' ELSE 'v2' END", "CASE WHEN user_id % 4 = 0 THEN 'guest' ELSE 'member' END"


def _pick(words) -> str:
    return f"{list(words)}[CAST({_PICK.format(n=len(words))} AS INTEGER)]"


def _facts_sql() -> str:
    words = ", ".join(f"({M._literal(w)}, CAST({list(marks)} AS VARCHAR[]), {M._literal(c)}, {M._literal(t)})" for w, marks, c, t in C.vocabulary())
    topics = ", ".join(f"('{t.ident}', '{t.module}', {str(t.needs_login).lower()}, CAST({list(t.barred)} AS VARCHAR[]))" for t in C.TOPICS)
    active = [t.ident for t in C.TOPICS if t.active]
    return f"""SELECT user_id, event_id, list_concat(coalesce(wm, CAST([] AS VARCHAR[])), CASE WHEN regexp_matches(w, '^[0-9]+$') THEN ['digits'] ELSE CAST([] AS VARCHAR[]) END) AS marks, choice, target, target_module,
  coalesce(target_login, false) AS target_login, coalesce(list_contains(barred, role), false) AS target_barred, number, current_version FROM (
  SELECT x.*, wm, choice, coalesce(topic, CASE WHEN number > 0 THEN {active}[number] END) AS target FROM (
    SELECT user_id, event_id, lower(trim({_pick(TALK)})) AS w, TRY_CAST(lower(trim({_pick(TALK)})) AS INTEGER) AS number, {_VERSION} AS current_version, {_ROLE} AS role FROM events) x
  LEFT JOIN (VALUES {words}) v(word, wm, choice, topic) ON w = word)
  LEFT JOIN (VALUES {topics}) t(ident, target_module, target_login, barred) ON target = ident"""


_KINDS = {"event_id": "BIGINT"}


def _messages(spark, d):
    at = F.expr(_PICK.format(n=len(TALK)).replace("//", "DIV")).cast("int")
    e = table(spark, d, "events").select("user_id", "event_id", F.element_at(F.array(*map(F.lit, TALK)), at).alias("message"), F.expr(_VERSION).alias("told"), F.expr(_ROLE).alias("role"))
    return C.with_facts(e, "message", "role", "told")


@query("st01_st02_conversation", M.sql_outcomes(_facts_sql(), "user_id", ["event_id"], MACHINE, _KINDS))
def conversation(spark, d):
    """Every event of every user through all rules: what decided, what is replied, side outputs, the state after."""
    return M.run_batch(_messages(spark, d), "user_id", ["event_id"], MACHINE).withColumn("sides", F.array_join("sides", ","))


@query("st01_last_states", f"""
WITH o AS ({M.sql_outcomes(_facts_sql(), "user_id", ["event_id"], MACHINE, _KINDS)})
SELECT user_id, {', '.join(f'arg_max(struct_pack(x := {f}), event_id).x AS {f}' for f in MACHINE.fields)}, count(*) AS n_events FROM o GROUP BY 1""")
def conversation_states(spark, d):
    return M.last_states(M.run_batch(_messages(spark, d), "user_id", ["event_id"], MACHINE), "user_id", ["event_id"], MACHINE)


ANSWERS = ("accept", "hello", "refuse", "accept", "revoke", "other")
_CONSENTS = f"""SELECT user_id, event_id, [{_pick(ANSWERS)}] AS marks, {_VERSION} AS current_version, CASE WHEN event_id % 3 = 0 THEN 'button' ELSE 'explicit_consent' END AS source_told FROM events"""


def _consents(spark, d):
    at = F.expr(_PICK.format(n=len(ANSWERS)).replace("//", "DIV")).cast("int")
    e = table(spark, d, "events").select("user_id", "event_id", F.array(F.element_at(F.array(*map(F.lit, ANSWERS)), at)).alias("marks"), F.expr(_VERSION).alias("current_version"),
                                         F.when(F.col("event_id") % 3 == 0, "button").otherwise("explicit_consent").alias("source_told"))
    return M.run_batch(e, "user_id", ["event_id"], LIFECYCLE)


@query("st08_consent_history", f"""
SELECT user_id, event_id, reply, status, version, source FROM ({M.sql_outcomes(_CONSENTS, "user_id", ["event_id"], LIFECYCLE, _KINDS)}) WHERE sides = 'history'""")
def consent_history(spark, d):
    """A row for each change of a user's consent, the withdrawals of outdated ones among them."""
    return M.side_output(_consents(spark, d), "history").select("user_id", "event_id", "reply", "status", "version", "source")


@query("st08_consent_states", f"""
WITH o AS ({M.sql_outcomes(_CONSENTS, "user_id", ["event_id"], LIFECYCLE, _KINDS)})
SELECT user_id, {', '.join(f'arg_max(struct_pack(x := {f}), event_id).x AS {f}' for f in LIFECYCLE.fields)}, count(*) AS n_events FROM o GROUP BY 1""")
def consent_states(spark, d):
    return M.last_states(_consents(spark, d), "user_id", ["event_id"], LIFECYCLE)
