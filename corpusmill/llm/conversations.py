"""Ordered conversations from message rows, validated by a finite-state automaton.

The automaton reads the roles in order: at most one system message at the start, then user
and assistant in turn, ending with the assistant. Its state is the role it read last, so a
stretch of rows is summed up by its first role, its last role, its length and
whether every step inside was legal. Rows are sorted in stretches of one hour of one session, so a
session of any size is spread over tasks; the stretches' summaries are then chained.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import materialize

SYSTEM, USER, ASSISTANT = 0, 1, 2
#: Seconds of a session that are sorted together.
STRETCH_SECONDS = 3600


def tidy(c: Column) -> Column:
    """Trimmed of white space and lower-cased."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def instant(c: Column) -> Column:
    """The instant of an ISO-8601 text with a date and a time, UTC if it names no offset; else null."""
    text = F.upper(F.trim(c))
    form = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?)\s*(?:Z|([+-]\d{2}):?(\d{2})?)?$"
    hours = F.regexp_extract(text, form, 3)
    offset = F.when(hours == "", F.lit("Z")).otherwise(F.concat(hours, F.lit(":"), F.coalesce(F.nullif(F.regexp_extract(text, form, 4), F.lit("")), F.lit("00"))))
    whole = F.concat(F.regexp_extract(text, form, 1), F.lit("T"), F.replace(F.regexp_extract(text, form, 2), F.lit(","), F.lit(".")), offset)
    return F.when(text.rlike(form), whole.try_cast("timestamp"))


def _legal(before: Column, role: Column) -> Column:
    return ((role == USER) & before.isin(SYSTEM, ASSISTANT)) | ((role == ASSISTANT) & (before == USER))


def latest(messages: DataFrame, *keep: str) -> DataFrame:
    """One row per message id, that received last (ties by the other columns): id, session, role code, instant, sound.

    A null id stands for no message in particular: such rows aren't merged."""
    rows = messages.select(
        F.col("id"),
        tidy(F.col("session_id")).alias("session"),
        tidy(F.col("role")).alias("__role"),
        instant(F.col("created_at")).alias("at"),
        F.coalesce(F.col("content").rlike(r"(?U)\S"), F.lit(False)).alias("__said"),
        F.col("received_at").alias("__received"),
        *keep,
    )
    code = F.when(F.col("__role") == "system", SYSTEM).when(F.col("__role") == "user", USER).when(F.col("__role") == "assistant", ASSISTANT)
    rows = rows.withColumn("role_code", code).withColumn("sound", F.col("role_code").isNotNull() & F.col("at").isNotNull() & F.col("__said"))
    order = [F.col(c).desc_nulls_last() for c in ("__received", "at", "session", "__role", "__said", *keep)]
    named = rows.where(F.col("id").isNotNull()).withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where("__n = 1").drop("__n")
    return named.unionByName(rows.where(F.col("id").isNull())).drop("__received", "__said", "__role").where(F.col("session").isNotNull())


def whole_conversations(messages: DataFrame, sessions: DataFrame, *keep: str) -> DataFrame:
    """session_id, turn_no (from 1), message_id, role and the kept columns of every message of every whole conversation.

    A conversation is broken, and left out, if one of its messages has no readable time, another role or blank content, if the roles' order isn't
    accepted, or if its session isn't in ``sessions``. Rows sent again count once, by id. Two messages of one role at one instant break it, so the order has no ties.
    A session without messages, and an empty table, give no rows. Extra columns aren't read unless kept.
    """
    rows = materialize(latest(messages, *keep), "p2-latest")
    broken = rows.where(~F.col("sound")).select("session").distinct()
    sound = rows.where("sound").withColumn("stretch", F.floor(F.unix_micros("at") / F.lit(STRETCH_SECONDS * 1_000_000)))
    w = Window.partitionBy("session", "stretch").orderBy("at", "role_code", "id")
    ordered = sound.select("*", F.row_number().over(w).alias("n"), F.lag("role_code").over(w).alias("before"))
    stretches = ordered.groupBy("session", "stretch").agg(
        F.min_by("role_code", "n").alias("first"),
        F.max_by("role_code", "n").alias("last"),
        F.count("*").alias("rows"),
        F.bool_and(F.col("before").isNull() | _legal(F.col("before"), F.col("role_code"))).alias("legal"),
    )
    chain = Window.partitionBy("session").orderBy("stretch")
    linked = stretches.select(
        "session",
        "stretch",
        "last",
        (F.sum("rows").over(chain.rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")).alias("offset"),
        (F.col("legal") & F.when(F.row_number().over(chain) == 1, F.col("first").isin(SYSTEM, USER)).otherwise(_legal(F.lag("last").over(chain), F.col("first")))).alias("legal"),
    )
    verdict = linked.groupBy("session").agg(F.bool_and("legal").alias("legal"), F.max_by("last", "stretch").alias("last"))
    known = sessions.select(tidy(F.col("id")).alias("session")).distinct()
    good = verdict.where(F.col("legal") & (F.col("last") == ASSISTANT)).select("session").join(broken, "session", "left_anti").join(known, "session", "left_semi")
    offsets = linked.select("session", "stretch", "offset").join(good, "session")
    return ordered.join(offsets, ["session", "stretch"]).select(
        F.col("session").alias("session_id"),
        (F.col("offset") + F.col("n")).cast("int").alias("turn_no"),
        F.col("id").alias("message_id"),
        F.element_at(F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), F.col("role_code") + 1).alias("role"),
        *keep,
    )
