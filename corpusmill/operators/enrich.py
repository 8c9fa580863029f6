"""Default enrichment without models, and the folds and interfaces that models plug into."""

from __future__ import annotations

import heapq
import json
import math
import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import store
from corpusmill.operators.retrieval import terms_of
from corpusmill.session import materialize, spread

#: Terms whose counts are sent to all tasks, and the greatest filter of terms of several texts (a power of two of bits: 16 MB), with the tasks that fill it.
FREQUENT, MOST_BITS, FILTER_TASKS = 100_000, 27, 32


class Embedder(Protocol):
    """Texts to unit vectors of one length."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    """Scores of candidate texts for a query."""

    def score(self, query: str, texts: list[str]) -> list[float]: ...


class Recognizer(Protocol):
    """Named entities (name, type) of a text."""

    def entities(self, text: str) -> list[tuple[str, str]]: ...


class Provider(Protocol):
    """A language model behind a chat."""

    def chat(self, messages: list[dict[str, str]]) -> str: ...


class HashingEmbedder:
    """Unit vectors by feature hashing of words: for tests and for use without a model."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        import numpy as np
        import xxhash

        out = np.zeros((len(texts), self.size))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = xxhash.xxh3_64_intdigest(w)
                out[i, h % self.size] += 1 if h >> 63 else -1
        return (out / (np.sqrt((out * out).sum(1, keepdims=True)) + 1e-9)).tolist()


def embed(df: DataFrame, key: str, text: str, embedder: Embedder, batch: int = 32) -> DataFrame:
    """key and vector of each row's text; a null text is embedded as an empty one. The embedder is sent to each worker once."""
    held = df.sparkSession.sparkContext.broadcast(embedder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, batch):
                part = b.slice(k, batch)
                vectors = held.value.embed([x or "" for x in part.column(1).to_pylist()])
                yield pa.record_batch([part.column(0), pa.array(vectors, pa.list_(pa.float32()))], ["key", "vector"])

    return df.select(F.col(key).alias("key"), text).mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, vector array<float>")


def _grams(text: str) -> Counter:
    t = terms_of(text)
    return Counter([*t, *map(" ".join, zip(t, t[1:]))])


def keywords(df: DataFrame, key: str, text: str, most: int = 6, least_words: int = 10) -> DataFrame:
    """key, keyword, score and rank: the terms and pairs of neighbouring terms of highest tf-idf of each text of ``least_words`` words. Ties go to the smaller text.

    How often a term stands in a text is counted within the text, in how many texts with one shuffle of each task's sums. The terms of most texts, ``FREQUENT`` at most, are sent to all tasks, which then know their scores, and bounds of all others;
    a filter of fixed size tells which others stand in one text only. Only terms that may be among a text's best, and aren't
    known yet, are joined with their counts. So no frequent term is shuffled, and few others. Scores are exact.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    d = spread(df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("x")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["keyword", "n"])
            held.clear()
            return out

        for b in batches:
            for x in b.column(1).to_pylist():
                held.update(_grams(x).keys())
                if len(held) > 200_000:
                    yield rows()
        yield rows()

    df_ = materialize(d.mapInArrow(count, "keyword string, n long").groupBy("keyword").agg(F.sum("n").alias("df")).where("df > 1"), "keyword-texts")
    texts = d.count()
    several, all_ = df_.agg(F.count("*"), F.sum("df")).first()
    least = max(2, (all_ or 0) // FREQUENT + 1)  # no more than FREQUENT terms can stand in so many texts
    known = {r.keyword: r.df for r in df_.where(F.col("df") >= least).toLocalIterator()}
    size = 1 << min(MOST_BITS, max(10, math.ceil(math.log2(1 + 10 * several))))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for b in batches:
            bits[[xxhash.xxh3_64_intdigest(g) & (size - 1) for g in b.column(0).to_pylist()]] = True
        yield pa.record_batch([pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["bits"])

    repeated = np.zeros(size // 8, np.uint8)  # has the hashes of all terms of two texts or more: others stand in one for sure
    for r in df_.select("keyword").coalesce(FILTER_TASKS).mapInArrow(fill, "bits binary").toLocalIterator():
        repeated |= np.frombuffer(bytes(r.bits), np.uint8)
    shared = spark.sparkContext.broadcast((known, repeated.tobytes()))
    idf = lambda n: math.log((1 + texts) / (1 + n))
    high = idf(1)

    def hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, repeated = shared.value
        for b in (whole.slice(k, 2_000) for whole in batches for k in range(0, whole.num_rows, 2_000)):
            rows, found, tfs, dfs = [], [], [], []
            for i, x in enumerate(b.column(1).to_pylist()):
                sure, open_ = [], []
                for g, tf in _grams(x).items():
                    n = known.get(g)
                    if n is None:
                        h = xxhash.xxh3_64_intdigest(g) & (size - 1)
                        if repeated[h >> 3] >> (h & 7) & 1:
                            open_.append((-tf * high, g, tf, None))
                            continue
                        n = 1
                    sure.append((-tf * idf(n), g, tf, n))
                best = heapq.nsmallest(most, sure)
                # scores within rounding of the last sure one stay; of equal scores the smaller text is first
                bar, last = (best[-1][0] + 1e-5, best[-1]) if len(best) == most else (math.inf, None)
                kept = [c for c in sure if c[0] <= bar and (last is None or c <= last or c[0] != last[0])]
                kept += [c for c in open_ if c[0] <= bar and (last is None or c[0] != last[0] or c[1] < last[1])]
                for _, g, tf, n in kept:
                    rows.append(i)
                    found.append(g)
                    tfs.append(tf)
                    dfs.append(n)
            yield pa.record_batch([b.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string()), pa.array(tfs, pa.int64()), pa.array(dfs, pa.int64())], ["k", "keyword", "tf", "known"])

    cand = d.where(T.word_count(F.col("x")) >= least_words).mapInArrow(hopeful, f"k {kind}, keyword string, tf long, known long")
    rare = cand.where("known IS NULL").join(df_, "keyword", "left").select("k", "keyword", "tf", F.coalesce("df", F.lit(1)).alias("df"))
    both = cand.where("known IS NOT NULL").select("k", "keyword", "tf", F.col("known").alias("df")).unionByName(rare)
    scored = both.select(F.col("k").alias(key), "keyword", F.round(F.col("tf") * F.log(F.lit(float(1 + texts)) / (1 + F.col("df"))), 6).alias("score"))
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), "keyword")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def capitalised(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and name: runs of two or more capitalised words, once per text. The default recogniser; it knows no types."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Z][a-z]+(?: [A-Z][a-z]+)+)"), F.lit(1)))
    return df.where(F.col(text).isNotNull()).select(key, F.explode(found).alias("name"))


def rolling_keys(chunks: DataFrame) -> DataFrame:
    """collection, tag, first_chunk, last_chunk and count of every tag, over chunk_index."""
    tags = chunks.select("collection", "chunk_index", F.explode(T.tag_list(F.col("concept_tags"))).alias("tag"))
    return tags.groupBy("collection", "tag").agg(F.min("chunk_index").alias("first_chunk"), F.max("chunk_index").alias("last_chunk"), F.count("*").alias("count"))


def concept_sections(chunks: DataFrame, most: int = 20) -> DataFrame:
    """The tags of most sections: tag and sections."""
    s = chunks.select("collection", store.heading_of().alias("section"), F.explode(T.tag_list(F.col("concept_tags"))).alias("tag")).distinct()
    return s.groupBy("tag").agg(F.count("*").alias("sections")).orderBy(F.col("sections").desc(), "tag").limit(most)


def ledger(updates: list[tuple[str, str]], start: dict[str, int] | None = None) -> dict[str, int]:
    """Counts after (tag, action) updates in order: add and refine raise a count, downweight lowers a known one to 0 at least, mention only enters a new tag."""
    out = dict(start or {})
    for tag, action in updates:
        if not tag:
            continue
        if action in ("add", "refine"):
            out[tag] = out.get(tag, 0) + 1
        elif action == "mention":
            out.setdefault(tag, 1)
        elif action == "downweight" and tag in out:
            out[tag] = max(0, out[tag] - 1)
    return out


def concept_ledger(df: DataFrame, keys: list[str], order: list[str], tag: str, action: str) -> DataFrame:
    """keys, tag and count after all updates of each key in order.

    The floor at 0 makes the fold depend on the order, but each tag is counted on its own; so (key, tag) are folded apart, streamed from sorted partitions.
    """

    def fold(key, rows):
        count = None
        for (act,) in rows:
            if act in ("add", "refine"):
                count = (count or 0) + 1
            elif act == "mention":
                count = 1 if count is None else count
            elif act == "downweight" and count is not None:
                count = max(0, count - 1)
        if count is not None:
            yield (*key, count)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, tag]) + ", count int"
    return store.streamed(df.where(F.col(tag).isNotNull() & (F.col(tag) != "")), [*keys, tag], order, [action], schema, fold)


def repaired_json(reply: str | None) -> Any:
    """The longest JSON array or object in a model's reply, or None.

    Code fences are looked into first; control characters, commas before a closing bracket and single quotes are forgiven."""
    if not reply:
        return None
    found = re.findall(r"```(?:\w+)?\s*(.*?)```", reply, re.S) + [reply]
    best, size = None, -1
    for text in found:
        for start in (m.start() for m in re.finditer(r"[\[{]", text)):
            part = _balanced(text, start)
            if part is None or len(part) <= size:
                continue
            value = _parsed(part)
            if value is not None:
                best, size = value, len(part)
        if best is not None and text is not reply:
            continue
    return best


def _balanced(text: str, start: int) -> str | None:
    depth, quote, skip = 0, "", False
    for i in range(start, len(text)):
        c = text[i]
        if skip:
            skip = False
        elif quote:
            skip = c == "\\"
            quote = "" if c == quote else quote
        elif c == '"':
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


def _parsed(part: str) -> Any:
    tries: list[Callable[[str], str]] = [
        lambda s: s,
        lambda s: re.sub(r",\s*([\]}])", r"\1", re.sub(r"[\x00-\x1f]+", " ", s)),
        lambda s: re.sub(r",\s*([\]}])", r"\1", re.sub(r"[\x00-\x1f]+", " ", s)).replace("'", '"'),
    ]
    for mend in tries:
        try:
            return json.loads(mend(part))
        except ValueError:
            continue
    return None


#: Chunks of one request, tokens of a pass over a section, words below which a chunk isn't sent, tries of a request and models to fall back on.
REQUEST_CHUNKS, PASS_TOKENS, SENT_WORDS, TRIES = 5, 5_000, 15, 3
#: Fields that a model fills, with their kinds: a text, or a list that is stored comma-joined. The first three must be there for a cached entry to count.
FIELDS = {"title": str, "summary": str, "questions": list, "tags": list, "concept_tags": list, "semantic_key": str}


class Refused(Exception):
    """The provider won't answer this request; asking again doesn't help."""


class Busy(Exception):
    """The provider has no room or no time just now."""


def classified(error: Exception) -> Exception:
    """The error as one of the two above, by its text or name; others stay."""
    said = f"{error} {type(error).__name__}".lower()
    if any(x in said for x in ("403", "moderation", "flagged")):
        return Refused(str(error))
    return Busy(str(error)) if any(x in said for x in ("429", "rate", "timeout", "timed out")) else error


class Asker:
    """Requests to a provider: repeated with growing pauses, no faster than ``pause`` seconds apart; ``models`` are fallbacks, tried one after the other."""

    def __init__(self, provider: Provider, models: tuple[str, ...] = (), pause: float = 0.0, sleep: Callable[[float], None] = time.sleep):
        self.provider, self.models, self.pause, self.sleep, self.last = provider, models, pause, sleep, None

    def _once(self, messages: list[dict[str, str]], **model: str) -> str:
        if self.last is not None and self.pause:
            self.sleep(max(0.0, self.pause - (time.monotonic() - self.last)))
        self.last = time.monotonic()
        try:
            reply = self.provider.chat(messages, **model)
        except Exception as e:
            raise classified(e) from e
        if reply is None:
            raise ValueError("the provider gave no reply")
        return reply

    def ask(self, messages: list[dict[str, str]]) -> str:
        for k in range(TRIES):
            try:
                return self._once(messages)
            except Refused:
                raise
            except Exception as e:
                if k == TRIES - 1:
                    raise
                if isinstance(e, Busy):
                    self.sleep(3 * 2**k)
        raise AssertionError

    def fall_back(self, messages: list[dict[str, str]]) -> str:
        errors = []
        for model in self.models:
            try:
                return self._once(messages, model=model)
            except Exception as e:  # the next model may do better
                errors.append(f"{model}: {e}")
        raise RuntimeError("; ".join(errors) or "no model to fall back on")


class RollingKeys:
    """The concept tags met so far, those of the latest chunks kept: at most a third of the chunks, between 50 and 200."""

    def __init__(self, chunks: int):
        self.most, self.seen = min(max(chunks // 3, 50), 200), {}

    def add(self, tags: list[str], at: int) -> None:
        for t in (t.strip().lower() for t in tags):
            if t:
                _, n = self.seen.get(t, (0, 0))
                self.seen[t] = (at, n + 1)
        if len(self.seen) > self.most:
            self.seen = dict(sorted(self.seen.items(), key=lambda x: -x[1][0])[: self.most])

    def listed(self) -> str:
        return listed({t: n for t, (_, n) in self.seen.items()}, "(none yet)")


def listed(counts: dict[str, int], nothing: str) -> str:
    """Counts for a prompt, the highest first, a line each."""
    return "\n".join(f"- {t} ({n}x)" for t, n in sorted(counts.items(), key=lambda x: -x[1])) or nothing


def passages(batch: list[dict]) -> str:
    """Chunks for a prompt, numbered, with what is known about them."""
    cue = lambda c: f" [keywords: {c.get('keywords') or ''}; entities: {c.get('entities') or ''}]" if c.get("keywords") or c.get("entities") else ""
    return "\n\n".join(f"Passage {i}{cue(c)}\n{c['text']}" for i, c in enumerate(batch, 1))


def filled(answer: dict) -> dict:
    """A model's answer for one chunk as columns: texts, comma-joined lists, and importance (3 if it's missing or no number)."""
    out = {f: ", ".join(map(str, answer.get(f) or [])) if kind is list else str(answer.get(f) or "") for f, kind in FIELDS.items()}
    try:
        out["importance"] = int(answer.get("importance", 3))
    except (TypeError, ValueError):
        out["importance"] = 3
    return out


def enriched(chunks: Iterator[dict], asker: Asker, title: str = "", count: int = 0) -> Iterator[dict]:
    """What a model says about each chunk of one document, in order: chunk dicts (text, keywords, entities, section, and cached: fields known already or None) with ``filled`` fields and ``how``.

    Chunks of under ``SENT_WORDS`` words are passed over ("short"); known ones are taken ("cached"). Others go in requests of ``REQUEST_CHUNKS``, each with the tags met so far and the chunk before; a reply of another number of answers counts as
    failed, and failed requests go to the fallback models, at the end of those that are held. What fails there, too, stays empty ("failed"). Only a request's chunks are held, besides failed ones.
    """
    keys, before, failed = RollingKeys(count), "(first request)", []

    def request(batch: list[dict], ask: Callable[[list[dict[str, str]]], str], context: str) -> list[dict] | None:
        prompt = f"Book: {title or 'unknown'}\nSection: {batch[0].get('section') or '(untitled)'}\nBefore: {context}\nTags so far:\n{keys.listed()}\n\n{passages(batch)}"
        system = "For each passage give a JSON object with title, summary, tags, concept_tags, importance (1 to 5), semantic_key and questions; reply with a JSON array in the order of the passages."
        try:
            found = repaired_json(ask([{"role": "system", "content": system}, {"role": "user", "content": prompt}]))
        except Exception:
            return None
        return found if isinstance(found, list) and len(found) == len(batch) and all(isinstance(x, dict) for x in found) else None

    def settle(batch: list[dict], answers: list[dict], how: str) -> Iterator[dict]:
        for c, a in zip(batch, answers):
            keys.add([str(t) for t in a.get("concept_tags") or []], c["at"])
            yield {**c, **filled(a), "how": how}

    def flush(batch: list[dict]) -> Iterator[dict]:
        nonlocal before
        answers = request(batch, asker.ask, before)
        if answers is None:
            failed.append(list(batch))
            return
        before = "; ".join(str(answers[-1].get(k) or "") for k in ("title", "summary"))
        yield from settle(batch, answers, "asked")

    batch: list[dict] = []
    for at, c in enumerate(chunks):
        c = {**c, "at": at}
        if len(c["text"].split()) < SENT_WORDS:
            yield {**c, "how": "short"}
        elif c.get("cached"):
            yield {**c, **c["cached"], "how": "cached"}
        else:
            batch.append(c)
            if len(batch) == REQUEST_CHUNKS:
                yield from flush(batch)
                batch = []
    if batch:
        yield from flush(batch)
    for batch in failed:
        answers = request(batch, asker.fall_back, "(asked again)")
        yield from settle(batch, answers, "fallback") if answers is not None else ({**c, "how": "failed"} for c in batch)


_STAGE = ["title", "summary", "questions", "tags", "concept_tags", "semantic_key"]


def enrich_chunks(chunks: DataFrame, asker: Asker, cache: DataFrame | None = None) -> DataFrame:
    """chunk_key, content_hash, how, importance and the fields of ``FIELDS`` of every chunk, asked from a model document by document (collection, episode_num) in the order of chunk_index.

    ``cache`` (content_hash and fields, see ``cached``) spares known texts. Documents are streamed from sorted partitions, so none is held. Null texts count as empty."""
    c = chunks.select("chunk_key", "collection", "episode_num", "chunk_index", F.coalesce("text", F.lit("")).alias("text"), "keywords", "entities", store.heading_of().alias("section"), F.col("episode_title").alias("book"))
    c = c.withColumn("content_hash", T.content_hash(F.col("text")))
    fields = F.struct(*_STAGE, "importance")
    known = cache.select("content_hash", F.to_json(fields).alias("cached")) if cache is not None else None
    c = c.join(known, "content_hash", "left") if known is not None else c.withColumn("cached", F.lit(None).cast("string"))
    held = chunks.sparkSession.sparkContext.broadcast(asker)

    def fold(key, rows):
        title = ""

        def stream():
            nonlocal title
            for k, h, text, keywords_, entities, section, book, cached_, n in rows:
                title = book or title
                yield {"chunk_key": k, "content_hash": h, "text": text, "keywords": keywords_, "entities": entities, "section": section, "cached": json.loads(cached_) if cached_ else None, "n": n}

        first = stream()
        head = next(first, None)
        if head is None:
            return
        for x in enriched(chain([head], first), held.value, title, head["n"]):
            yield (x["chunk_key"], x["content_hash"], x["how"], x.get("importance", 3), *(x.get(f, "") for f in _STAGE))

    size = chunks.groupBy("collection", "episode_num").agg(F.count("*").alias("n"))
    c = c.join(size, ["collection", "episode_num"])
    kind = chunks.schema["chunk_key"].dataType.simpleString()
    return store.streamed(c, ["collection", "episode_num"], ["chunk_index", "chunk_key"], ["chunk_key", "content_hash", "text", "keywords", "entities", "section", "book", "cached", "n"], f"chunk_key {kind}, content_hash string, how string, importance int, {', '.join(f'{f} string' for f in _STAGE)}", fold)


def cached(results: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """The cache with what a run of ``enrich_chunks`` learnt: one entry a text, only whole ones (with title, summary and questions); newer ones replace older."""
    cols = ["content_hash", *_STAGE, "importance"]
    new = results.where(F.col("how").isin("asked", "fallback") & (F.col("title") != "") & (F.col("summary") != "") & (F.col("questions") != "")).select(*cols, F.lit(1).alias("__new"))
    both = new if cache is None else new.unionByName(cache.select(*cols, F.lit(0).alias("__new")))
    w = Window.partitionBy("content_hash").orderBy(F.col("__new").desc(), *_STAGE)
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*cols)


def section_summary(chunks: Iterator[dict], asker: Asker, book: str = "", section: str = "") -> dict:
    """A running summary of a section's chunks (text, title, summary, concept_tags, importance): summary, entities, points, tensions and the ledger of concepts.

    Chunks go in passes of at most ``PASS_TOKENS`` tokens. Every tag of a pass counts in the ledger; the model's themes enter it, and its updates raise and lower it. A failed pass is asked again of the fallback models
    at the end, with the summary and ledger of its time. Only a pass is held, besides failed ones."""
    out: dict[str, Any] = {"summary": "", "key_entities": [], "notable_points": [], "tensions": [], "ledger": {}}
    failed: list[tuple[str, str]] = []

    def prompt(batch: list[dict]) -> str:
        rows = "\n".join(json.dumps({k: c.get(k) for k in ("title", "summary", "concept_tags", "importance", "text")}, ensure_ascii=False) for c in batch)
        return f"Book: {book or 'unknown'}\nSection: {section}\nSummary so far: {out['summary'] or '(first pass)'}\nConcepts:\n{listed(out['ledger'], '(none yet)')}\n\n{rows}"

    def learn(reply: str) -> None:
        found = repaired_json(reply)
        found = found[0] if isinstance(found, list) and found else found
        if not isinstance(found, dict):
            raise ValueError("no JSON object in the reply")
        out["summary"] = found.get("section_summary") or out["summary"]
        for name, field in (("key_entities", "key_entities"), ("notable_points", "notable_points"), ("tensions", "open_questions_or_tensions")):
            out[name] += [x for x in dict.fromkeys(found.get(field) or []) if x not in out[name]]
        updates = [(t, "mention") for t in found.get("section_themes") or []]
        updates += [(u.get("concept_tag", ""), u.get("action", "keep")) for u in found.get("ledger_updates") or [] if isinstance(u, dict)]
        out["ledger"] = ledger(updates, out["ledger"])

    def go(batch: list[dict]) -> None:
        out["ledger"] = ledger([(t.strip(), "add") for c in batch for t in (c.get("concept_tags") or "").split(",") if t.strip()], out["ledger"])
        asked = prompt(batch)
        try:
            learn(asker.ask([{"role": "user", "content": asked}]))
        except Exception:
            failed.append((asked, section))

    batch, filled_ = [], 0
    for c in chunks:
        n = len(c.get("text") or "") // 4
        if batch and filled_ + n > PASS_TOKENS:
            go(batch)
            batch, filled_ = [], 0
        batch.append(c)
        filled_ += n
    if batch:
        go(batch)
    for asked, _ in failed:
        try:
            learn(asker.fall_back([{"role": "user", "content": asked}]))
        except Exception:  # the rest of the section stands
            continue
    return out


def summarize_sections(chunks: DataFrame, asker: Asker) -> DataFrame:
    """collection, section, summary and (as JSON) key_entities, notable_points, tensions and ledger of every section of every collection, in the order of its chunks; streamed from sorted partitions."""
    held = chunks.sparkSession.sparkContext.broadcast(asker)
    c = chunks.withColumn("section", F.coalesce(F.nullif(F.col("section_heading"), F.lit("")), F.lit("(untitled)")))

    def fold(key, rows):
        names = ("text", "title", "summary", "concept_tags", "importance", "episode_title")
        first = next(rows)
        s = section_summary((dict(zip(names, r)) for r in chain([first], rows)), held.value, first[5] or key[0], key[1])
        yield (*key, s["summary"], *(json.dumps(s[k], ensure_ascii=False) for k in ("key_entities", "notable_points", "tensions", "ledger")))

    return store.streamed(c, ["collection", "section"], ["episode_num", "chunk_index", "chunk_key"], ["text", "title", "summary", "concept_tags", "importance", "episode_title"], "collection string, section string, summary string, key_entities string, notable_points string, tensions string, ledger string", fold)


def summarize_books(sections: DataFrame, asker: Asker, most: int = 20) -> DataFrame:
    """collection, overview, main_themes, key_takeaways, tags (as JSON) and error of every collection, from its sections' summaries and the concepts of most sections. A model that fails leaves an empty overview and its error."""
    held = sections.sparkSession.sparkContext.broadcast(asker)

    def fold(key, rows):
        parts, spread = [], Counter()
        for section, summary, tensions, ledger_ in rows:
            concepts = json.loads(ledger_ or "{}")
            spread.update(concepts.keys())
            parts.append(f"### {section}\n{summary}\nConcepts: {', '.join(concepts)}\nTensions: {', '.join(json.loads(tensions or '[]'))}")
        common = "\n".join(f"- {t} (in {n} sections)" for t, n in sorted(spread.items(), key=lambda x: (-x[1], x[0]))[:most]) or "(none)"
        found, error = {}, None
        try:
            reply = repaired_json(held.value.ask([{"role": "user", "content": f"Book: {key[0]}\nConcepts:\n{common}\n\n" + "\n\n".join(parts)}]))
            found = reply[0] if isinstance(reply, list) and reply else reply
            if not isinstance(found, dict):
                raise ValueError("no JSON object in the reply")
        except Exception as e:
            found, error = {}, str(e)
        yield (*key, str(found.get("overview") or ""), *(json.dumps(found.get(k) or [], ensure_ascii=False) for k in ("main_themes", "key_takeaways", "tags")), error)

    return store.streamed(sections, ["collection"], ["section"], ["section", "summary", "tensions", "ledger"], "collection string, overview string, main_themes string, key_takeaways string, tags string, error string", fold)


def programmatic(chunks: DataFrame, recognizer: Recognizer | None = None) -> DataFrame:
    """The chunks with keywords (comma-joined, the best six) and entities (a JSON array of name and type, empty for none) written anew, by ``keywords`` and a recogniser (by default capitalised names without a type)."""
    k = keywords(chunks, "chunk_key", "text").groupBy("chunk_key").agg(F.array_sort(F.collect_list(F.struct("rank", "keyword"))).alias("k"))
    k = k.select("chunk_key", F.array_join(F.transform("k", lambda x: x["keyword"]), ", ").alias("keywords"))
    if recognizer is None:
        e = capitalised(chunks, "chunk_key", "text").select("chunk_key", "name", F.lit("UNKNOWN").alias("type"))
    else:
        held = chunks.sparkSession.sparkContext.broadcast(recognizer)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(i, *e) for i, x in enumerate(b.column(1).to_pylist()) for e in dict.fromkeys(held.value.entities(x))]
                yield pa.record_batch([b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["chunk_key", "name", "type"])

        e = chunks.where("text IS NOT NULL").select("chunk_key", "text").mapInArrow(run, f"chunk_key {chunks.schema['chunk_key'].dataType.simpleString()}, name string, type string")
    e = e.groupBy("chunk_key").agg(F.to_json(F.array_sort(F.collect_set(F.struct("name", "type")))).alias("entities"))
    out = chunks.drop("keywords", "entities").join(k, "chunk_key", "left").join(e, "chunk_key", "left")
    return out.withColumns({"keywords": F.coalesce("keywords", F.lit("")), "entities": F.coalesce("entities", F.lit(""))}).select(*chunks.columns)


def with_tags(keywords_: Any, tags: list[str]) -> Any:
    """Keywords (a column of comma-joined text) with the first eight tags of a video added."""
    more = ", ".join(tags[:8])
    return F.when(F.coalesce(keywords_, F.lit("")) == "", F.lit(more)).otherwise(F.concat(keywords_, F.lit(f", {more}" if more else "")))


def with_prefixes(chunks: DataFrame, asker: Asker) -> DataFrame:
    """The chunks with a model's sentence about each before its text; where it fails the text stays."""
    held = chunks.sparkSession.sparkContext.broadcast(asker)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, name, title in zip(*(b.column(k).to_pylist() for k in (1, 2, 3))):
                try:
                    said = held.value.ask([{"role": "user", "content": f"Collection: {name}\nEpisode: {title}\n\nSay in one or two sentences what this excerpt covers, with its terms:\n\n{text}"}])
                    texts.append(f"{said.strip()}\n\n{text}")
                except Exception:
                    texts.append(text)
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], ["chunk_key", "text"])

    new = chunks.select("chunk_key", "text", "collection_display", "episode_title").mapInArrow(run, f"chunk_key {chunks.schema['chunk_key'].dataType.simpleString()}, text string")
    return chunks.drop("text").join(new, "chunk_key").select(*chunks.columns)
