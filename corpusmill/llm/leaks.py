"""Test passages in training text, by generalised suffix automata over words.

The automata of the test items are built from their normalised words, packed into arrays and broadcast;
training texts are streamed through them word by word, keeping the longest suffix
that stands in some item. Where that reaches the run length, the items of the run
come from the one state that holds its last ``run`` words. A text is read once, by all automata of a
scan; nothing is shuffled but the found pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import shingles
from corpusmill.session import materialize

#: Consecutive words that count as a leaked passage.
RUN = 12
#: Words of test items in one automaton, and automata of one scan. More items make more scans, each written out before
#: the next, so what is broadcast at once is bounded; results don't depend on either.
AUTOMATON_WORDS, SCAN_AUTOMATA = 500_000, 8
#: A text of which leaked passages cover more than this part is dropped whole.
MOST_COVERED = 0.5


@dataclass
class Packed:
    """An automaton as arrays: what is broadcast. Row k of ``moves`` is (state, word, next state)."""

    run: int
    ids: list[Any]
    words: list[str]
    moves: np.ndarray
    link: np.ndarray
    length: np.ndarray
    holder: np.ndarray
    held: np.ndarray


class Builder:
    """The suffix automaton of several word sequences."""

    def __init__(self, items: list[tuple[Any, list[str]]], run: int = RUN):
        self.run = run
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ids = [i for i, _ in items]
        self.number: dict[str, int] = {}
        sequences = [[self.number.setdefault(w, len(self.number)) for w in words] for _, words in items]
        for words in sequences:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.link[0] = 0
        # holder[s]: the state on s's suffix path that has s's last `run` words
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        self.holder = [-1] * len(order)
        for s in order:
            if self.length[s] >= run:
                self.holder[s] = s if self.length[self.link[s]] < run else self.holder[self.link[s]]
        held: set[tuple[int, int]] = set()
        for n, words in enumerate(sequences):
            s = 0
            for w in words:
                s = self.next[s][w]
                if self.holder[s] >= 0:
                    held.add((self.holder[s], n))
        self.held = sorted(held)

    def _add(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        clone = self._add(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new, p = self._add(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def packed(self) -> Packed:
        rows = [(s, w, t) for s, m in enumerate(self.next) for w, t in m.items()]
        ints = lambda x, *shape: np.array(x, np.int32).reshape(-1, *shape)
        return Packed(self.run, self.ids, list(self.number), ints(rows, 3), ints(self.link), ints(self.length), ints(self.holder), ints(self.held, 2))


@dataclass
class Automaton:
    """A packed automaton, unpacked by the worker that reads texts with it."""

    packed: Packed
    moves: dict[int, int] = field(init=False)

    def __post_init__(self) -> None:
        p = self.packed
        self.run, self.ids = p.run, p.ids
        self.number = {w: k for k, w in enumerate(p.words)}
        self.wide = max(1, len(p.words))
        self.moves = dict(zip((p.moves[:, 0].astype(np.int64) * self.wide + p.moves[:, 1]).tolist(), p.moves[:, 2].tolist()))
        self.link, self.length, self.holder = p.link.tolist(), p.length.tolist(), p.holder.tolist()
        self.items: dict[int, set[int]] = {}
        for s, n in p.held.tolist():
            self.items.setdefault(s, set()).add(n)

    def hits(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(place of the last word, length of the longest match that ends there, state with
        the last ``run`` words) wherever a run is complete."""
        moves, link, length, run, holder, wide, number = self.moves, self.link, self.length, self.run, self.holder, self.wide, self.number
        s = n = 0
        for i, word in enumerate(words):
            w = number.get(word)
            if w is None:
                s = n = 0
                continue
            t = moves.get(s * wide + w)
            if t is None:
                while s:
                    s = link[s]
                    t = moves.get(s * wide + w)
                    if t is not None:
                        break
                if t is None:
                    n = 0
                    continue
                n = length[s]
            s = t
            n += 1
            if n >= run:
                # n may be less than the state's longest; the run's state is at or above s
                h = s
                while length[link[h]] >= run:
                    h = holder[h] if holder[h] != h else link[h]
                yield i, n, h

    def found(self, words: list[str]) -> set[Any]:
        """The ids of the items that have a run in common with the words."""
        out: set[int] = set()
        for h in {h for _, _, h in self.hits(words)}:
            out |= self.items.get(h, set())
        return {self.ids[n] for n in out}

    def spans(self, words: list[str]) -> list[tuple[int, int]]:
        """The leaked stretches as [first word, past the last word), merged where they meet."""
        return merged((i - n + 1, i + 1) for i, n, _ in self.hits(words))


def merged(spans) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def automata(items: DataFrame, key: str, text: str, run: int = RUN) -> Iterator[list[Packed]]:
    """Automata over the items, those of one scan at a time. Items are read one by one; no more than a scan's are held."""
    scan: list[Packed] = []
    block: list[tuple[Any, list[str]]] = []
    size = 0
    for row in items.where(F.col(text).isNotNull()).select(key, text).distinct().toLocalIterator():
        words = shingles.words(row[1])
        if len(words) < run:
            continue
        if block and size + len(words) > AUTOMATON_WORDS:
            scan.append(Builder(block, run).packed())
            block, size = [], 0
            if len(scan) == SCAN_AUTOMATA:
                yield scan
                scan = []
        block.append((row[0], words))
        size += len(words)
    if block:
        scan.append(Builder(block, run).packed())
    if scan:
        yield scan


def _scans(df: DataFrame, items: DataFrame, key: str, text: str, run: int, read, name: str) -> DataFrame | None:
    """``read(df, broadcast, last)`` over all scans; None without items. All but the last are written out, so that one scan's automata are held at a time."""
    spark = df.sparkSession
    out, held = df, None
    for scan in automata(items, key, text, run):
        if held is not None:
            out = materialize(read(out, held, False), name)
            held.unpersist()
        held = spark.sparkContext.broadcast(scan)
    return None if held is None else read(out, held, True)


def leaked(docs: DataFrame, doc_key: str, text: str, items: DataFrame, item_key: str, item_text: str, run: int = RUN) -> DataFrame:
    """doc_key and item_key of each document that holds ``run`` consecutive words of the item.

    Null and empty texts, and items of fewer words, hold nothing; rows are distinct; an empty table on
    either side gives no rows. Items pass the driver one by one, in automata of bounded size; texts never do.
    """
    spark = docs.sparkSession
    kinds = docs.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"doc {kinds[0]}, item {kinds[1]}, text string"
    item_type = pa.int64() if kinds[1] == "bigint" else None

    def read(df: DataFrame, shared, last: bool) -> DataFrame:
        """The rows with an item, passed on; and, for rows with a text, what it holds and the text, if there is another scan."""

        def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scan = [Automaton(p) for p in shared.value]
            for b in batches:
                keys, found = b.column(0), []
                for row, (item, text_) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                    if item is not None:
                        found.append((row, item, None))
                        continue
                    words = shingles.words(text_)
                    found += [(row, i, None) for i in {i for a in scan for i in a.found(words)}]
                    if not last:
                        found.append((row, None, text_))
                if found:
                    rows, ids, texts = zip(*found)
                    yield pa.record_batch([keys.take(pa.array(rows, pa.int64())), pa.array(ids, item_type), pa.array(texts, pa.string())], ["doc", "item", "text"])

        return df.mapInArrow(run_batches, schema)

    plain = docs.where(F.col(text).isNotNull()).select(docs[doc_key].alias("doc"), F.lit(None).cast(kinds[1]).alias("item"), docs[text].alias("text"))
    out = _scans(plain, items, item_key, item_text, run, read, "p7-leaked")
    out = spark.createDataFrame([], schema) if out is None else out.where("item IS NOT NULL")
    return out.select("doc", "item").distinct().select(F.col("doc").alias(doc_key), F.col("item").alias(item_key))


def cleaned(docs: DataFrame, doc_key: str, text: str, items: DataFrame, item_key: str, item_text: str, run: int = RUN, most: float = MOST_COVERED) -> DataFrame:
    """Every document with its leaked passages cut out: doc_key, spans, leaked_words, words, dropped, text.

    The passages of all items are found on the document's own words, merged where they meet, and cut once; so the result doesn't depend on how the items
    are spread over automata. A document of which they cover more than ``most`` of the words is dropped: its text is null. Others lose the characters from
    the first to the last word of each passage. Null texts stay null, with no words.
    """
    kind = docs.schema[doc_key].dataType.simpleString()
    spans = "array<struct<a:int,b:int>>"
    arrow = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def read(df: DataFrame, shared, last: bool) -> DataFrame:
        def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scan = [Automaton(p) for p in shared.value]
            for b in batches:
                out = []
                for text_, known in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    words = shingles.words(text_) if text_ else []
                    out.append([{"a": s, "b": e} for s, e in merged([*((x["a"], x["b"]) for x in known), *(x for a in scan for x in a.spans(words))])])
                yield pa.record_batch([b.column(0), b.column(1), pa.array(out, arrow)], ["doc", "text", "found"])

        return df.mapInArrow(run_batches, f"doc {kind}, text string, found {spans}")

    def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [cut(t, [(x["a"], x["b"]) for x in f], most) for t, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int32()] * 3 + [pa.bool_(), pa.string()])]
            yield pa.record_batch([b.column(0), *cols], ["doc", "spans", "leaked_words", "words", "dropped", "text"])

    plain = docs.select(docs[doc_key].alias("doc"), docs[text].alias("text"), F.array().cast(spans).alias("found"))
    found = _scans(plain, items, item_key, item_text, run, read, "p7-spans")
    out = (plain if found is None else found).mapInArrow(cut_batches, f"doc {kind}, spans int, leaked_words int, words int, dropped boolean, text string")
    return out.withColumnRenamed("doc", doc_key)


def cut(text: str | None, found: list[tuple[int, int]], most: float) -> tuple[int, int, int, bool, str | None]:
    """(spans, leaked words, words, dropped, text) of a text with the leaked stretches of its words."""
    if text is None:
        return 0, 0, 0, False, None
    if not found:
        return 0, 0, len(shingles.words(text)), False, text
    places = shingles.places(text)
    leaked_words = sum(e - s for s, e in found)
    if leaked_words > most * len(places):
        return len(found), leaked_words, len(places), True, None
    out, at = [], 0
    for s, e in found:
        out.append(text[at : places[s][0]])
        at = max(at, places[e - 1][1])
    return len(found), leaked_words, len(places), False, "".join(out) + text[at:]
