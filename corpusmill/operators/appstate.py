"""Sessions, messages, settings and ingests as append-only rows with derived views, and answers from sources."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from copy import deepcopy
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.enrich import Provider
from corpusmill.operators.feedback import latest

SESSIONS = "id string, title string, created_at timestamp, updated_at timestamp, provider string, model string"
MESSAGES = "id string, session_id string, role string, content string, sources_json string, created_at timestamp"
SETTINGS = "key string, value_json string, updated_at timestamp"
INGESTS = "collection string, source_path string, status string, chunks int, at timestamp, error string"
ROLES = ("user", "assistant", "system")
# Status of an ingest that has ended, and of one that can go on.
ENDED = ("done", "failed")


def now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def new_session(title: str = "New Chat", provider: str = "", model: str = "", at: datetime | None = None) -> tuple:
    """A row of ``SESSIONS`` with a new id of 12 hexadecimal digits."""
    t = at or now()
    return (uuid.uuid4().hex[:12], title, t, t, provider, model)


def new_message(session: str, role: str, content: str, sources: list[dict] | None = None, at: datetime | None = None) -> tuple:
    """A row of ``MESSAGES``."""
    if role not in ROLES:
        raise ValueError(f"unknown role: {role}")
    return (uuid.uuid4().hex[:12], session, role, content, json.dumps(sources) if sources else None, at or now())


def append(table: DataFrame, rows: list[tuple]) -> DataFrame:
    """The table with more rows."""
    return table.unionByName(table.sparkSession.createDataFrame(rows, table.schema))


def current_sessions(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions in their latest state; a message also updates its session."""
    last = messages.groupBy(F.col("session_id").alias("id")).agg(F.max("created_at").alias("said"))
    s = latest(sessions, ["id"], ["updated_at"]).join(last, "id", "left")
    return s.withColumn("updated_at", F.greatest("updated_at", "said")).drop("said")


def delete_session(sessions: DataFrame, messages: DataFrame, session: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without a session and its messages."""
    return sessions.where(~F.col("id").eqNullSafe(session)), messages.where(~F.col("session_id").eqNullSafe(session))


def setting(settings: DataFrame, key: str, default: Any = None) -> Any:
    """The last value set under a key."""
    row = settings.where(F.col("key") == key).orderBy(F.col("updated_at").desc()).select("value_json").first()
    return default if row is None else json.loads(row[0])


def ingests(log: DataFrame, resumable: bool = False) -> DataFrame:
    """The latest state of each collection's ingest, or only those that didn't end."""
    last = latest(log, ["collection"], ["at"])
    return last.where(~F.col("status").isin(*ENDED)) if resumable else last


def without_fetches(interactions: DataFrame, session: str) -> DataFrame:
    """The log after a session's memory of what it fetched is reset; ratings come from the whole log and stay."""
    return interactions.where(~(F.col("session_id").eqNullSafe(session) & (F.col("action") == "get_context")))


def merged(base: dict, over: dict) -> dict:
    """Settings laid over others, level by level."""
    out = deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else deepcopy(v)
    return out


def setting_at(config: dict, path: str, default: Any = None) -> Any:
    """The value at a path with dots."""
    for k in path.split("."):
        if not isinstance(config, dict) or k not in config:
            return default
        config = config[k]
    return config


class Providers:
    """Language models by name, one of them active."""

    def __init__(self, known: dict[str, Provider]):
        self.known, self._active = dict(known), next(iter(known), None)

    @property
    def active(self) -> Provider | None:
        return self.known.get(self._active)

    def activate(self, name: str) -> None:
        if name not in self.known:
            raise ValueError(f"unknown provider: {name}")
        self._active = name


def answer(provider: Provider, messages: list[dict[str, str]], find: Callable[[str], str], system: str = "Answer from the sources.") -> str:
    """The model's answer to the last user message, with the context that ``find`` gives for it."""
    asked = next((m["content"] for m in reversed(messages) if m["role"] == "user"), "")
    prompt = [{"role": "system", "content": system}, *messages[:-1], {"role": "user", "content": f"{asked}\n\n---\nSources:\n\n{find(asked)}"}]
    return provider.chat(prompt)


def sub_queries(provider: Provider | None, question: str, parse: Callable[[str], list[str]], most: int = 4) -> list[str]:
    """The simpler queries that a model makes of a question; the question itself without a model, on its failure, or for at most one query."""
    if provider is None:
        return [question]
    try:
        found = parse(provider.chat([{"role": "user", "content": f"Split into at most {most} search queries, one a line:\n{question}"}]))[:most]
    except Exception:  # a model that can't be reached leaves a plain search
        return [question]
    return found if len(found) > 1 else [question]


INTERACTIONS = "id long, session_id string, occurred_at timestamp, action string, query string, chunk_ids_shown string, chunk_ids_fetched string, chunk_ids_ignored string, chunk_ids_rated string, rating int, metadata_json string"
# What a session can do.
ACTIONS = ("search", "search_deep", "get_context", "rate_result", "find_related", "reset_session")


def new_interaction(session: str, action: str, query: str | None = None, shown: list[str] | None = None, fetched: list[str] | None = None, rated: list[str] | None = None, rating: int | None = None, metadata: dict | None = None, at: datetime | None = None) -> tuple:
    """A row of ``INTERACTIONS``; what was shown and not fetched, when something was, counts as ignored. Ratings are derived from these rows (``feedback.chunk_ratings``)."""
    if action not in ACTIONS:
        raise ValueError(f"unknown action: {action}")
    ignored = [x for x in shown or [] if x not in set(fetched)] if fetched else []
    text = lambda x: json.dumps(x) if x else None
    return (uuid.uuid4().int >> 65, session, at or now(), action, query, text(shown), text(fetched), text(ignored), text(rated), rating, text(metadata))


def new_ingest(collection: str, path: str, status: str = "started", chunks: int = 0, error: str | None = None, at: datetime | None = None) -> tuple:
    """A row of ``INGESTS``."""
    return (collection, path, status, chunks, at or now(), error)


def ingest_states(log: DataFrame) -> DataFrame:
    """collection, source_path, status, chunks, started_at, completed_at and error of each collection's latest ingest: it began with the last "started", and is complete once it is done or has failed."""
    began = log.where("status = 'started'").groupBy("collection").agg(F.max("at").alias("started_at"))
    last = latest(log, ["collection"], ["at"])
    return last.join(began, "collection", "left").select("collection", "source_path", "status", "chunks", "started_at", F.when(F.col("status").isin(*ENDED), F.col("at")).alias("completed_at"), "error")


def resumed_session(sessions: DataFrame, messages: list[dict[str, str]], session: str | None = None, at: datetime | None = None) -> tuple[str, tuple | None]:
    """(id, new row or None): the session of that id if it exists, else a new one whose title is the first 80 characters of the first user message."""
    if session is not None and not sessions.where(F.col("id") == session).isEmpty():
        return session, None
    title = next((m["content"][:80] for m in messages if m["role"] == "user" and m["content"]), "New Chat")
    row = new_session(title, at=at)
    return row[0], row


def chat(provider: Provider, sessions: DataFrame, messages: list[dict[str, str]], find: Callable[[str], tuple[str, list[dict]]], session: str | None = None, at: datetime | None = None) -> tuple[str, list[tuple], list[tuple]]:
    """(reply, session rows to append, message rows to append): an answer from sources, with both sides of the exchange kept. ``find`` gives the context and the sources of a question; if it fails the answer has none."""
    asked = next((m["content"] for m in reversed(messages) if m["role"] == "user"), "")
    try:
        context, sources = find(asked)
    except Exception:  # an answer without sources is better than none
        context, sources = "", []
    reply = answer(provider, messages, lambda _: context)
    own, row = resumed_session(sessions, messages, session, at)
    t = at or now()
    return reply, [row] if row else [], [new_message(own, "user", asked, at=t), new_message(own, "assistant", reply, sources, at=t)]


def instructions(collections: DataFrame, chunks: int, cross_source: int, provider: str | None = None) -> str:
    """What the store holds, for an agent: chunks, collections (the first five names), topics in order, entities in several sources. A store without collections says so."""
    names = [r[0] for r in collections.select("collection_display").orderBy("collection").limit(6).collect()]
    if not names:
        return "Nothing is indexed yet."
    topics = [r[0] for r in collections.where("topic <> ''").select("topic").distinct().orderBy("topic").collect()]  # topics are few
    n = collections.select("collection").distinct().count()
    parts = [f"{chunks} chunks in {n} collections ({', '.join(names[:5])}{', ...' if len(names) > 5 else ''})."]
    parts += [f"Topics: {', '.join(topics)}."] if topics else []
    parts += [f"{cross_source} entities connect several sources."] if cross_source else []
    parts += [] if provider else ["No model is active: only plain search."]
    return " ".join(parts)


def ingest_all(sources: list[tuple[str, str]], run: Callable[[str, str], int], at: Callable[[], datetime] = now) -> list[tuple]:
    """Rows of ``INGESTS`` of a batch of (collection, path), each run in turn; one that fails doesn't stop the others."""
    log = []
    for collection, path in sources:
        log.append(new_ingest(collection, path, at=at()))
        try:
            log.append(new_ingest(collection, path, "done", run(collection, path), at=at()))
        except Exception as e:
            log.append(new_ingest(collection, path, "failed", error=f"{type(e).__name__}: {e}"[:500], at=at()))
    return log
