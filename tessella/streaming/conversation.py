"""The conversation of a user as a state machine: language, consent, topics, modules and global commands.

What a message says is a matter of the event alone: `with_facts` looks the normalised message up in a vocabulary
(a small table) and finds the topic that it names or numbers. Rules come in the order of their names; a letter tells
the outcomes of one rule apart. Topics and words are parameters; those below are neutral examples.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .machine import Differs, Has, Is, Lookup, Machine, Of, Rule


class Topic(NamedTuple):
    ident: str
    title: str
    #: free, search, interaction, monitoring, page (a web page), menu (a knowledge base)
    module: str = "free"
    active: bool = True
    needs_login: bool = False
    documents: bool = False
    subscribable: bool = False
    #: Roles that may not enter.
    barred: tuple[str, ...] = ()


TOPICS = (
    Topic("harbour", "harbour rules", "menu", subscribable=True), Topic("tides", "tide tables", "search"), Topic("cargo", "cargo pairs", "interaction"),
    Topic("lights", "lights", "monitoring"), Topic("charts", "charts", "page"), Topic("customs", "customs", documents=True), Topic("pilots", "pilots", needs_login=True),
    Topic("crew", "crew", barred=("guest",)), Topic("old", "old", active=False),
)
#: Marks, and the language or the topic that a message names. Digits and texts are told apart by their form.
WORDS: list[tuple[str, list[str], str | None, str | None]] = [
    ("support", ["support"], None, None), ("support site", ["support", "contact"], None, None), ("form", ["form"], None, None), ("stop", ["stop"], None, None),
    ("back_to_themes", ["back_to_topics"], None, None), ("back_to_language", ["back_to_language"], None, None), ("language", ["language"], None, None), ("/language", ["language"], None, None),
    ("start", ["start"], None, None), ("/start", ["start"], None, None), ("fr", [], "fr", None), ("ar", [], "ar", None), ("es", [], "es", None), ("ru", [], "ru", None),
    ("accept", ["accept"], None, None), ("1", ["accept", "card"], "fr", None), ("decline", ["decline"], None, None), ("2", ["decline", "card"], "ar", None), ("3", ["card"], "es", None),
    ("4", ["card"], "ru", None), ("5", ["card"], None, None), ("full", ["full"], None, None), ("menu", ["menu"], None, None), ("profile", ["profile"], None, None), ("help", ["help"], None, None),
    ("card", ["card"], None, None), ("back", ["back"], None, None), ("auth ok", ["login"], None, None),
]
LEGACY_QUESTIONS, LEGACY_SOFTWARE = ("legacy_question", "legacy_compliance"), ("legacy_callback", "legacy_benefits", "legacy_software", "legacy_data")
ONBOARDING = ("onboarding_role", "onboarding_city", "onboarding_software")
MODULES = {"search": "search", "interaction": "interaction", "monitoring": "monitoring"}


def vocabulary(topics: tuple[Topic, ...] = TOPICS, words=tuple(WORDS)) -> list[tuple]:
    """(message, marks, language, topic) of every known message; payloads are theme_<id>, titles are what they say."""
    named = [(f"theme_{t.ident}", ["payload"], None, t.ident) for t in topics if t.active]
    return [*words, *named, *((t.title, ["title"], None, t.ident) for t in topics if t.active)]


def with_facts(events: DataFrame, message: str, role: str, version: str, topics: tuple[Topic, ...] = TOPICS, words=tuple(WORDS)) -> DataFrame:
    """events with marks, choice, target, target_module, target_login, target_barred, number and version. The vocabulary
    is a bounded table, joined by the trimmed message in lower case."""
    told = events.sparkSession.createDataFrame(vocabulary(topics, words), "_word string, _marks array<string>, choice string, _topic string")
    active = [t.ident for t in topics if t.active]
    facts = events.sparkSession.createDataFrame([(t.ident, t.module, t.needs_login, list(t.barred)) for t in topics], "target string, target_module string, target_login boolean, _barred array<string>")
    word = F.lower(F.trim(F.coalesce(F.col(message), F.lit(""))))
    digits = word.rlike("^[0-9]+$")
    number = F.when(digits, F.expr("try_cast(_w as int)"))
    by_number = F.try_element_at(F.array(*map(F.lit, active)), F.when(F.col("number") > 0, F.col("number")))
    out = events.withColumn("_w", word).withColumn("number", number)
    out = out.join(F.broadcast(told), F.col("_w") == F.col("_word"), "left")
    marks = F.concat(F.coalesce("_marks", F.array().cast("array<string>")), F.when(F.col("_w").rlike("^[0-9]+$"), F.array(F.lit("digits"))).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("marks", marks).withColumn("target", F.coalesce("_topic", by_number)).join(F.broadcast(facts), "target", "left")
    barred = F.coalesce(F.array_contains("_barred", F.col(role)), F.lit(False))
    return out.withColumns({"target_barred": barred, "target_login": F.coalesce("target_login", F.lit(False)), "current_version": F.col(version)}).drop("_w", "_word", "_marks", "_topic", "_barred")


def conversation(topics: tuple[Topic, ...] = TOPICS, cards: bool = True) -> Machine:
    """The machine. cards: whether the menu is a carousel, which is a state; as plain text it changes none."""
    menu = {"state": "carousel"} if cards else {}
    consented, not_consented = Is("consent", ("accepted",)), Is("consent", ("accepted",), False)
    in_topic, no_topic = Is("topic", ("known",)), Is("topic", ("known",), False)

    def state(*names):
        return Is("state", names)

    def to_topic(name, target):
        return {"state": name, "theme": target}

    def enter(name: str, *when) -> list[Rule]:
        """Outcomes of the start of the topic that the event names."""
        gate = Is("target_login", (True,)), Is("authenticated", (False, None))
        return [
            Rule(f"{name}a", ((*when, Is("target", (None,))),), {"state": "main_menu", "theme": None}, "no such topic"),
            Rule(f"{name}b", ((*when, *gate),), to_topic("login", Of("target")), "log in"),
            Rule(f"{name}c", ((*when, Is("target_barred", (True,))),), {}, "not for this role"),
            *(Rule(f"{name}d_{m}", ((*when, Is("target_module", (m,))),), to_topic(s, Of("target")), f"{m} opened") for m, s in MODULES.items()),
            Rule(f"{name}e", ((*when, Is("target_module", ("page",))),), {"state": "carousel", "theme": None}, "page"),
            Rule(f"{name}f", ((*when,),), to_topic("free_question", Of("target")), "ask"),
        ]

    def again(name: str, *when) -> list[Rule]:
        """The same for the topic that the user is in."""
        return [
            *(Rule(f"{name}d_{m}", ((*when, Is("topic_module", (m,))),), {"state": s}, f"{m} opened") for m, s in MODULES.items()),
            Rule(f"{name}e", ((*when, Is("topic_module", ("page",))),), {"state": "carousel", "theme": None}, "page"),
            Rule(f"{name}f", ((*when,),), {"state": "free_question"}, "ask"),
        ]

    digits = Has("marks", "digits")
    gated = Is("topic_login", (True,)), Is("authenticated", (False, None))
    withdrawn = {"consent": "none", "version": None}
    rules = [
        Rule("01a", ((Has("marks", "support"), Has("marks", "contact", False)),), {}, "support", ("support",)),
        Rule("01b", ((Has("marks", "contact"),),), sides=("support",), goes_on=True),
        Rule("02", ((Has("marks", "form"),),), {}, "form"),
        Rule("03", ((Has("marks", "stop"),),), {"state": "consent", "theme": None, "language": None, "authenticated": False, **withdrawn}, "stopped", ("consent", "unsubscribe")),
        Rule("04a", ((Has("marks", "back_to_topics"), consented),), menu, "menu"),
        Rule("04b", ((Has("marks", "back_to_topics"),),), {}, "consent?"),
        Rule("04c", ((Has("marks", "back_to_language"),),), {"state": "language", "language": None}, "language?"),
        Rule("05", ((Has("marks", "language"),),), {"state": "language", "language": None}, "language?"),
        Rule("06", ((Has("marks", "start"),),), {"state": "language", "theme": None, "language": None, "authenticated": False, **withdrawn}, "language?", ("consent", "unsubscribe")),
        Rule("07", ((Is("language", (None,)), Is("state", ("language", "consent"), False)),), {"language": "fr"}, goes_on=True),
    ]
    asking = (Is("language", (None,)),), (state("language"),)
    chosen = Is("choice", (None,), False)
    rules += [
        Rule("08a", tuple((*way, chosen, consented) for way in asking), {"language": Of("choice"), "state": "main_menu", **menu}, "menu"),
        Rule("08b", tuple((*way, chosen) for way in asking), {"language": Of("choice"), "state": "consent"}, "consent?"),
        Rule("08c", asking, {}, "language?"),
        Rule("09a", ((not_consented, Has("marks", "accept")),), {"consent": "accepted", "version": Of("current_version"), "authenticated": False, **menu}, "welcome", ("consent",)),
        Rule("09b", ((not_consented, Has("marks", "decline")),), {"consent": "refused", "state": "consent"}, "refused", ("consent",)),
        Rule("09c", ((not_consented, Has("marks", "full")),), {}, "full text"),
        Rule("09d", ((not_consented,),), {}, "consent?"),
        Rule("10", ((Differs("version", "current_version"),),), {"state": "consent", "theme": None, **withdrawn}, "new terms", ("consent",)),
        Rule("11", ((Is("topic", ("gone",)),),), {"state": "main_menu", "theme": None}, "topic gone"),
        Rule("12", ((Has("marks", "menu"),),), menu, "menu"),
        Rule("13a", ((Has("marks", "profile"),),), {}, "profile"),
        Rule("13b", ((Has("marks", "help"),),), {}, "help"),
        Rule("14", ((Has("marks", "card"),),), {}, "card"),
        Rule("15a", ((Has("marks", "back"), state(*LEGACY_QUESTIONS)),), {}, "menu"),
        Rule("15b", ((Has("marks", "back"), state(*LEGACY_SOFTWARE)),), {"state": "carousel", "theme": None}, "menu"),
        Rule("15c", ((Has("marks", "back"), state("free_question"), in_topic, *gated),), {"state": "login"}, "log in"),
        Rule("15d", ((Has("marks", "back"), state("free_question"), in_topic),), {"state": "topic_menu"}, "topic menu"),
        Rule("15e", ((Has("marks", "back"),),), menu, "menu"),
        Rule("16a", ((Has("marks", "login"), in_topic),), {"authenticated": True, "state": "topic_menu"}, "topic menu"),
        Rule("16b", ((Has("marks", "login"),),), {"authenticated": True, "state": "main_menu", "theme": None}, "main menu"),
        *enter("17p", Has("marks", "payload")),
        *enter("17t", Has("marks", "title"), no_topic),
        *(Rule(f"18{i}", ((state(s),),), {"state": n}, "onboarding") for i, (s, n) in enumerate(zip(ONBOARDING, (*ONBOARDING[1:], "carousel")))),
        Rule("19a", ((digits, in_topic, *gated),), {"state": "login"}, "log in"),
        *again("19b", digits, in_topic, Is("number", (1,))),
        Rule("19c", ((digits, in_topic, Is("topic_subscribable", (True,)), Is("number", (2,))),), {"state": "topic_menu"}, "subscribed", ("subscribe",)),
        Rule("19d", ((digits, in_topic, Is("topic_subscribable", (True,)), Is("number", (3,))), (digits, in_topic, Is("topic_subscribable", (True,), False), Is("number", (2,)))), {"state": "main_menu", "theme": None}, "main menu"),
        Rule("19e", ((digits, in_topic),), {"state": "topic_menu"}, "no such choice"),
        Rule("19f", ((digits, Is("target_module", ("menu",)), Is("target_login", (True,)), Is("authenticated", (False, None))),), to_topic("login", Of("target")), "log in"),
        Rule("19g", ((digits, Is("target_module", ("menu",))),), to_topic("topic_menu", Of("target")), "topic menu"),
        *enter("19h", digits),
        Rule("20", ((state(*MODULES.values()), in_topic),), {}, "module answer"),
        Rule("21", ((state(*LEGACY_QUESTIONS),),), {"state": "carousel", "theme": None}, "page"),
        Rule("22", ((state("document_question"), in_topic),), {}, "document answer", ("audit",)),
        Rule("23", ((state("carousel"),),), menu, "menu"),
        Rule("24", ((state(*LEGACY_SOFTWARE),),), {"state": "carousel", "theme": None}, "page"),
        Rule("25a", ((state("free_question"), in_topic),), {}, "topic answer"),
        Rule("25b", ((state("login"), in_topic, *gated),), {"state": "login"}, "log in"),
        Rule("25c", ((state("login"), in_topic),), {"state": "topic_menu"}, "topic menu"),
        Rule("26a", ((in_topic, Is("topic_documents", (True,))),), {"state": "document_question"}, "document answer", ("audit",)),
        Rule("26b", ((in_topic, *gated),), {"state": "login"}, "log in"),
        Rule("26c", ((in_topic,),), {"state": "topic_menu"}, "topic menu"),
        Rule("27", ((),), menu, "menu"),
    ]
    by = {t.ident: t for t in topics}
    lookups = (
        Lookup("topic", "theme", {k: "known" if t.active else "gone" for k, t in by.items()}, "none", "gone"),
        Lookup("topic_module", "theme", {k: t.module for k, t in by.items()}, "", ""),
        *(Lookup(f"topic_{name}", "theme", {k: getattr(t, attr) for k, t in by.items()}, False, False) for name, attr in (("login", "needs_login"), ("documents", "documents"), ("subscribable", "subscribable"))),
    )
    fields = {"state": "string", "theme": "string", "language": "string", "authenticated": "boolean", "consent": "string", "version": "string"}
    start = {"state": "language", "theme": None, "language": None, "authenticated": False, "consent": "none", "version": None}
    facts = ("marks", "choice", "target", "target_module", "target_login", "target_barred", "number", "current_version")
    return Machine(fields, start, facts, tuple(rules), lookups)


def consent_lifecycle() -> Machine:
    """Consent alone: state row and, as side output `history`, a row for each change. A consent given for another
    version than the current one is withdrawn and asked for again; so an accept then counts for the next message."""
    fields = {"status": "string", "version": "string", "source": "string"}
    gone = {"status": "none", "version": None, "source": None}
    is_on, history = Is("status", ("accepted",)), ("history",)
    return Machine(fields, gone, ("marks", "current_version", "source_told"), (
        Rule("revoke", ((Has("marks", "revoke"), Is("status", ("none",), False)),), gone, "revoked", history),
        Rule("outdated", ((is_on, Differs("version", "current_version")),), gone, "asked again", history),
        Rule("accept", ((Has("marks", "accept"), Is("status", ("accepted",), False)),), {"status": "accepted", "version": Of("current_version"), "source": Of("source_told")}, "accepted", history),
        Rule("refuse", ((Has("marks", "refuse"), Is("status", ("refused",), False)),), {"status": "refused", "version": Of("current_version"), "source": Of("source_told")}, "refused", history),
        Rule("same", ((),), {}, ""),
    ))
