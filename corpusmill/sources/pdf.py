"""The text program of PDF documents, on spans or markdown: which lines are headings and code, on which page a section stands, and chapters by their titles.

Rendering a PDF to spans is left to an extractor that is plugged in.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.sources.documents import Section, section

# Page markers, and the titles of chapters by which a text without headings is cut.
PAGE = r"<!--PAGE:(\d+)-->"
CHAPTERS = (
    r"^((?:Chapter|CHAPTER)\s+\w+[.:]\s*.*)",
    r"^([IVXivx]+\.\s+[A-Z][\w\s,&\'-]+)",
    r"^((?:Part|PART)\s+\w+[.:]\s*.*)",
    r"^((?:Section|SECTION)\s+\d+[.:]\s*.*)",
)
#: Flags of a span's font.
MONO, BOLD = 8, 16
#: Titles that a way of cutting needs, and characters that a chapter needs.
LEAST_CHAPTERS, LEAST_CHARS = 3, 200
_HEADER = re.compile(r"^(#{1,3})\s+(.*)", re.M)
_PAGE = re.compile(PAGE)
_BAD = re.compile(T.BAD_HEADING)


def markdown_of(lines: DataFrame, doc: str) -> DataFrame:
    """doc and markdown of every document, from its lines: page, line_no, x0 and spans (array of struct of text, font, flags and size).

    A line all in a fixed-width font is code, indented by its place; the first of a run opens a fence, the last closes it, and a page's end does, too. A line all in bold is a heading: "##" from 11 points if it has 20 words or fewer, else "#" from 14. Blank lines stay
    only in code. Windows run over a page, so no document is held but by its text.
    """
    spans = F.col("spans")
    font = lambda s: F.lower(s["font"])
    mono = F.forall(spans, lambda s: (s["flags"].bitwiseAND(MONO) != 0) | font(s).contains("mono") | font(s).contains("courier") | font(s).contains("consolas"))
    bold = F.forall(spans, lambda s: s["flags"].bitwiseAND(BOLD) != 0)
    rows = lines.where(F.size(spans) > 0).select(doc, "page", "line_no", "x0", F.regexp_replace(F.array_join(F.transform(spans, lambda s: s["text"]), ""), r"\s+$", "").alias("text"), mono.alias("mono"), bold.alias("bold"), spans[0]["size"].alias("size"))
    w = Window.partitionBy(doc, "page").orderBy("line_no")
    full = rows.where("text <> ''")
    full = full.withColumn("starts", F.col("mono") & ~F.coalesce(F.lag("mono").over(w), F.lit(False))).withColumn("ends", ~F.col("mono") & F.coalesce(F.lag("mono").over(w), F.lit(False)))
    full = full.withColumn("last", F.col("mono") & F.lead("mono").over(w).isNull())
    head = F.last(F.when(F.col("starts"), F.struct("x0", "size")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    indent = F.greatest(F.lit(0), F.round((F.col("x0") - head["x0"]) / F.greatest(head["size"] * 0.6, F.lit(1.0))).cast("int"))
    code = F.concat(F.when(F.col("starts"), F.lit("\n```\n")).otherwise(""), F.repeat(F.lit(" "), indent), F.col("text"))
    words = T.word_count(F.col("text"))
    prose = F.when(F.col("bold") & (F.col("size") >= 11) & (words <= 20), F.concat(F.lit("\n## "), F.col("text"), F.lit("\n"))).when(F.col("bold") & (F.col("size") >= 14), F.concat(F.lit("\n# "), F.col("text"), F.lit("\n"))).otherwise(F.col("text"))
    said = F.when(F.col("mono"), code).otherwise(F.concat(F.when(F.col("ends"), F.lit("```\n\n")).otherwise(""), prose))
    said = F.concat(said, F.when(F.col("last"), F.lit("\n```\n")).otherwise(""))
    between = rows.where("text = ''").select(doc, "page", "line_no").join(_code_runs(full, doc), [doc, "page"]).where(F.col("line_no").between(F.col("a"), F.col("b")))
    out = full.select(doc, "page", "line_no", said.alias("said")).unionByName(between.select(doc, "page", "line_no", F.lit("").alias("said")))
    pages = out.groupBy(doc, "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "said"))), lambda x: x["said"]), "\n").alias("body"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "body"))), lambda x: F.concat(F.lit("\n<!--PAGE:"), x["page"].cast("string"), F.lit("-->\n\n"), x["body"])), "\n")
    return pages.groupBy(doc).agg(text.alias("markdown"))


def _code_runs(full: DataFrame, doc: str) -> DataFrame:
    """doc, page, a, b: where runs of code begin and end in a page."""
    w = Window.partitionBy(doc, "page").orderBy("line_no")
    numbered = full.where("mono").withColumn("run", F.sum(F.col("starts").cast("int")).over(w))
    return numbered.groupBy(doc, "page", "run").agg(F.min("line_no").alias("a"), F.max("line_no").alias("b"))


def page_of(text: str, at: int) -> int:
    """The number of the last page marker before a place, 0 for none."""
    found = text.rfind("<!--PAGE:", 0, at)
    while found >= 0:
        m = _PAGE.match(text, found, at)
        if m:
            return int(m[1])
        found = text.rfind("<!--PAGE:", 0, found)
    return 0


def without_markers(text: str) -> str:
    return _PAGE.sub("", text).strip()


def heading_is_valid(title: str) -> bool:
    """As ``text.valid_heading``, for one title."""
    return 0 < len(title) <= 80 and not _BAD.search(title) and not (title.endswith(".") and " " in title and len(title.split()) > 5)


def header_sections(markdown: str) -> list[Section]:
    """Sections at headers with the page they stand on. A line that can't be a heading is folded, with what follows, into the section before, or opens a preamble."""
    marks = list(_HEADER.finditer(markdown))
    if not marks:
        whole = without_markers(markdown)
        return [section("(untitled)", whole, 0)] if whole else []
    before = without_markers(markdown[: marks[0].start()])
    out = [section("(preamble)", before, page_of(markdown, marks[0].start()))] if before else []
    for m, stop in zip(marks, [*(x.start() for x in marks[1:]), len(markdown)]):
        title, body = m[2].strip(), without_markers(markdown[m.end() : stop])
        if not body:
            continue
        if heading_is_valid(title):
            out.append(section(title, body, page_of(markdown, m.start())))
        elif out:
            out[-1]["text"] += f"\n\n{title}\n{body}"
        else:
            out.append(section("(preamble)", f"{title}\n{body}", page_of(markdown, m.start())))
    return out


def chapter_sections(text: str) -> list[Section]:
    """Sections at the titles of chapters: by the first kind of title that occurs three times. Bodies of 200 characters or fewer are dropped; of sections with one title, as in a table of contents, the longest stays (the first of equal ones)."""
    for pattern in CHAPTERS:
        marks = list(re.finditer(pattern, text, re.M))
        if len(marks) < LEAST_CHAPTERS:
            continue
        parts = [("(preamble)", without_markers(text[: marks[0].start()]), marks[0].start())]
        parts += [(re.sub(r"\s*\d+\s*$", "", m[1]).strip(), without_markers(text[m.end() : stop]), m.start()) for m, stop in zip(marks, [*(x.start() for x in marks[1:]), len(text)])]
        parts = [p for p in parts if len(p[1]) > LEAST_CHARS]
        best: dict[str, tuple[str, str, int]] = {}
        for p in parts:
            if p[0] not in best or len(p[1]) > len(best[p[0]][1]):
                best[p[0]] = p
        found = [section(t, body, page_of(text, at)) for t, body, at in parts if best[t][2] == at]
        if found:
            return found
    return []


def sections_of(markdown: str) -> list[Section]:
    """Sections by headers; if those make at most two, by chapters where there are any."""
    found = header_sections(markdown)
    return (len(found) <= 2 and chapter_sections(markdown)) or found


def sections(df: DataFrame, key: str, markdown: str, cut: Any = sections_of) -> DataFrame:
    """key, section_no (from 0), title, text and page_num of the sections of each row's markdown with page markers. Null and blank texts have none; each text is cut alone, nothing is shuffled."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = [(i, k, s["title"], s["text"], s["page_num"]) for i, t in enumerate(b.column(1).to_pylist()) for k, s in enumerate(cut(t))]
            cols = [pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int32()), (2, pa.string()), (3, pa.string()), (4, pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *cols], names=[key, "section_no", "title", "text", "page_num"])

    kind = df.schema[key].dataType.simpleString()
    return df.where(F.col(markdown).isNotNull()).select(key, markdown).mapInArrow(run, f"{key} {kind}, section_no int, title string, text string, page_num int")


def with_page(text: Column, position: Column) -> Column:
    """The number of the last page marker before a position (from 0) in a text, 0 for none."""
    found = F.regexp_extract_all(F.substring(text, F.lit(1), position), F.lit(PAGE), F.lit(1))
    return F.coalesce(F.element_at(found, -1).cast("int"), F.lit(0)) if position is not None else F.lit(0)
