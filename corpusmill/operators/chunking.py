"""Cutting texts, sections and timed segments into chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T


def chunk_words(tokens: int) -> int:
    return max(1, int(tokens * T.WORDS_PER_TOKEN))


def chunks_of(text: Column, tokens: int = 512, overlap: int = 0) -> Column:
    """array<string>: windows of words; a text that fits stays as it is but for white space at its ends; a blank text has none.

    With overlap, a tail that the window before holds whole is still a chunk."""
    most, common = chunk_words(tokens), max(0, int(overlap * T.WORDS_PER_TOKEN))
    step = max(1, most - common)
    whole, words = T.strip(text), T.words(text)
    windows = F.transform(F.sequence(F.lit(1), F.size(words), F.lit(step)), lambda i: F.array_join(F.slice(words, i, most), " "))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).when(F.size(words) <= most, F.array(whole)).otherwise(windows)


def chunk_text(df: DataFrame, text: str, *keys: str, tokens: int = 512, overlap: int = 0) -> DataFrame:
    """keys, chunk_index (from 0) and text of each chunk. Null and blank texts have none. Nothing is shuffled."""
    kept = df.where(F.col(text).isNotNull()).select(*keys, F.posexplode(chunks_of(F.col(text), tokens, overlap)).alias("chunk_index", "text"))
    return kept


def packed(sizes: Column, cap: int) -> Column:
    """Bin numbers (from 0) of greedy packing: a new bin when the next item would pass the cap and the bin isn't empty."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("items"), F.array().cast("array<int>").alias("bins"))

    def add(a: Column, x: Column) -> Column:
        full = (a["items"] > 0) & (a["sum"] + x > cap)
        last = F.when(F.size(a["bins"]) == 0, 0).otherwise(F.get(a["bins"], F.size(a["bins"]) - 1))
        return F.struct(
            F.when(full, x.cast("long")).otherwise(a["sum"] + x).alias("sum"),
            F.when(full, 1).otherwise(a["items"] + 1).alias("items"),
            F.concat(a["bins"], F.array(F.when(full, last + 1).otherwise(last))).alias("bins"),
        )

    return F.aggregate(sizes, start, add, lambda a: a["bins"])


def _sections(sections: list[dict] | None, tokens: int) -> Iterator[tuple[str, str, int, str]]:
    """(text, heading, page, chapter) of the chunks of one document's sections."""
    most = chunk_words(tokens)
    blocks = []
    for s in sections or []:
        body, title = ((s or {}).get(k) or "" for k in ("text", "title"))
        body, title = body.strip(), title.strip()
        if body:
            blocks.append((f"{title}\n{body}" if title else body, title, s.get("page_num") or 0, s.get("chapter") or ""))
    groups: list[list] = []
    filled = most
    for block in blocks:
        if filled >= most // 3:
            groups.append([])
            filled = 0
        groups[-1].append(block)
        filled += len(block[0].split())
    for group in groups:
        text = "\n".join(b[0] for b in group)
        largest, heading, page, chapter = -1, "", 0, ""
        for block, title, p, c in group:
            if len(block) > largest:
                largest, page, chapter = len(block), p, c
                heading = title or heading
        words = text.split()
        pieces = [text] if len(words) <= most else [" ".join(words[i : i + most]) for i in range(0, len(words), most)]
        for piece in pieces:
            yield piece, heading, page, chapter


def chunk_sections(df: DataFrame, key: str, sections: str, tokens: int = 512) -> DataFrame:
    """key, chunk_index, text, section_heading, page_num and chapter of the chunks of each document's sections.

    Sections without text are dropped; short ones are merged with those that follow, under the heading, page and chapter of the longest;
    long ones are cut. Null and empty arrays give no rows. Each document is folded alone, in one pass; nothing is shuffled.
    """
    names = ["chunk_index", "text", "section_heading", "page_num", "chapter"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, rows = [], []
            for i, s in enumerate(b.column(1).to_pylist()):
                for k, r in enumerate(_sections(s, tokens)):
                    index.append(i)
                    rows.append((k, *r))
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string()])]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(index, pa.int64())), *cols], names=[key, *names])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, sections).mapInArrow(run, f"{key} {kind}, chunk_index int, text string, section_heading string, page_num int, chapter string")


def windows_of(segments: Iterator[tuple[float, float, str]], target: float = 90, overlap: float = 15) -> Iterator[tuple[str, float, float]]:
    """(text, start, end) of overlapping windows over timed segments in order."""
    held: list[tuple[float, float, str]] = []
    for s in segments:
        held.append(s)
        if s[1] - held[0][0] >= target:
            yield " ".join(x[2] for x in held), held[0][0], s[1]
            kept, total = 0, 0.0
            while kept < len(held) and (not kept or total < overlap):
                kept += 1
                total += held[-kept][1] - held[-kept][0]
            held = held[-kept:]
    if held:
        yield " ".join(x[2] for x in held), held[0][0], held[-1][1]


def chunk_segments(df: DataFrame, keys: list[str], start: str, end: str, text: str, order: list[str], target: float = 90, overlap: float = 15) -> DataFrame:
    """keys, chunk_index, text, start_sec and end_sec of windows over each recording's segments.

    Recordings are streamed in sorted partitions, so only one window is held at a time. Rows with a null start, end or text are skipped.
    """
    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull() & F.col(text).isNotNull()).select(*keys, *order, F.col(start).cast("double").alias("__s"), F.col(end).cast("double").alias("__e"), F.col(text).alias("__t"))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "__s", "__e", *order).select(*keys, "__s", "__e", "__t")
    fields = rows.schema.fields[: len(keys)]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", chunk_index int, text string, start_sec double, end_sec double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        def stream():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        out: list[tuple] = []
        for key, group in groupby(stream(), lambda r: r[: len(keys)]):
            for i, w in enumerate(windows_of((r[len(keys) :] for r in group), target, overlap)):
                out.append((*key, i, *w))
                if len(out) >= 2_000:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], names=arrow.names)

    return rows.mapInArrow(run, schema)
