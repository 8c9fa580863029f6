"""Readers of documents: markup, plain text, code, e-books and web pages as sections.

A section is (title, text, page_num, chapter). Extractors take the bytes of one file; ``read_documents``
runs them over a folder, a row per file, and keeps failures in a column instead of failing the job.
"""

from __future__ import annotations

import ast
import html.parser
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T

SECTIONS = "array<struct<title:string,text:string,page_num:int,chapter:string>>"
Section = dict
#: Words that pack a web page's paragraphs, and fewest words of an e-book's section.
WEB_WORDS, EPUB_WORDS = 400, 10
# Folders of a code repository that aren't read.
SKIPPED = frozenset(".git node_modules __pycache__ .venv venv dist build .next target .idea .vscode".split())
_HEADER = re.compile(r"^(#{1,3})\s+(.*)", re.M)


def section(title: str, text: str, page: int = 0, chapter: str = "") -> Section:
    return {"title": title, "text": text, "page_num": page, "chapter": chapter}


def decoded(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def split_at(text: str, marks: list[tuple[int, int, str]], before: str = "") -> list[Section]:
    """Sections between marks (start, end, title); what stands before the first has the title ``before``; empty ones are dropped."""
    stops = [m[0] for m in marks[1:]] + [len(text)]
    parts = [section(before, text[: marks[0][0]].strip())] if marks else [section(before, text.strip())]
    parts += [section(title.strip(), text[end:stop].strip()) for (_, end, title), stop in zip(marks, stops)]
    return [p for p in parts if p["text"]]


def split_markdown(text: str, before: str = "") -> list[Section]:
    return split_at(text, [(m.start(), m.end(), m[2]) for m in _HEADER.finditer(text)], before)


def split_rst(text: str) -> list[Section]:
    """Titles are lines underlined with at least three, and at least as many, of one of = - ~ ^ and quotes."""
    lines = text.split("\n")
    at = _offsets(lines)
    marks = []
    for i in range(len(lines) - 1):
        title, under = lines[i].strip(), lines[i + 1].strip()
        if title and len(under) >= max(3, len(title)) and len(set(under)) == 1 and under[0] in '=-~^"':
            marks.append((at[i], min(len(text), at[i + 1] + len(lines[i + 1])), title))
    return split_at(text, marks)


def _offsets(lines: list[str]) -> list[int]:
    out, n = [], 0
    for x in lines:
        out.append(n)
        n += len(x) + 1
    return out


class _Page(html.parser.HTMLParser):
    """Text of a page as blocks, with headings and its title; some elements are left out."""

    OUT = frozenset("script style nav footer header noscript".split())
    BLOCK = frozenset("p div li tr h1 h2 h3 h4 h5 h6 br section article pre blockquote td th ul ol table".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.title, self.hidden, self.in_title = "", 0, False

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.OUT
        self.in_title |= tag == "title"
        if tag in self.BLOCK:
            self.parts.append("\n")
        if tag in ("h1", "h2", "h3") and not self.hidden:
            self.parts.append("#" * int(tag[1]) + " ")
        if tag == "pre" and not self.hidden:
            self.parts.append("```\n")

    def handle_endtag(self, tag):
        if tag == "pre" and not self.hidden:
            self.parts.append("\n```")
        self.hidden -= bool(self.hidden) and tag in self.OUT
        self.in_title &= tag != "title"
        if tag in self.BLOCK:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.hidden:
            self.parts.append(data)


def page(markup: str) -> tuple[str, str]:
    """(title, text with markdown headings) of an HTML page; broken markup gives what could be read."""
    p = _Page()
    p.feed(markup)
    p.close()
    lines = [re.sub(r"[ \t]+", " ", x).strip() for x in "".join(p.parts).split("\n")]
    return p.title.strip(), re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def split_html(markup: str) -> list[Section]:
    title, text = page(markup)
    plain = "\n".join(re.sub(r"^#{1,3} ", "", x) for x in text.split("\n") if x)
    return [section(title, plain)] if plain else []


def web_sections(text: str, title: str) -> list[Section]:
    """By headings; without any, paragraphs packed to 400 words. The first section without a title takes the page's."""
    if _HEADER.search(text):
        return split_markdown(text, title)
    packs: list[list[str]] = []
    words = 0
    for p in (x.strip() for x in text.split("\n\n")):
        if p:
            n = len(p.split())
            if not packs or words + n > WEB_WORDS:
                packs.append([])
                words = 0
            packs[-1].append(p)
            words += n
    out = [section("", "\n\n".join(x)) for x in packs] or [section(title, text.strip())]
    out[0]["title"] = out[0]["title"] or title
    return out


def extract_page(markup: str | None) -> tuple[str, list[Section]]:
    """Title and sections of a web page; a null one has no sections."""
    if markup is None:
        return "", []
    title, text = page(markup)
    return title, [s for s in web_sections(text, title) if s["text"]]


def extract_text(path: str, data: bytes) -> list[Section]:
    """Markdown, HTML, reStructuredText and plain text, by extension."""
    text, ext = decoded(data), PurePosixPath(path).suffix.lower()
    if ext == ".md":
        return split_markdown(text)
    if ext in (".html", ".htm"):
        return split_html(text)
    if ext == ".rst":
        return split_rst(text)
    return [section(PurePosixPath(path).stem, text.strip())] if text.strip() else []


def extract_code(path: str, data: bytes) -> list[Section]:
    """Python: a section for each top-level function and class, with the path and all imports before it. Other code, and code that
    can't be parsed: blocks between three line ends or more, of over 20 characters."""
    source = decoded(data)
    if path.endswith(".py"):
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError):
            tree = None
        if tree is not None:
            lines = source.split("\n")
            cut = lambda n, first: "\n".join(lines[first - 1 : n.end_lineno])
            imports = "\n".join(cut(n, n.lineno) for n in tree.body if isinstance(n, (ast.Import, ast.ImportFrom)))
            head = f"# {path}\n{imports}\n\n" if imports else f"# {path}\n\n"
            kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
            found = [section(n.name, head + cut(n, min([n.lineno, *(d.lineno for d in n.decorator_list)]))) for n in tree.body if isinstance(n, kinds)]
            if found:
                return found
    blocks = [b.strip() for b in re.split(r"\n\n\n+", source)]
    return [section(PurePosixPath(path).name, b) for b in blocks if len(b) > 20]


def extract_epub(path: str, data: bytes) -> list[Section]:
    """The spine's pages in order, cut at headings; sections of ten words or fewer are dropped."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        box = ET.fromstring(z.read("META-INF/container.xml"))
        root = next(e.get("full-path") for e in box.iter() if e.tag.endswith("rootfile"))
        package = ET.fromstring(z.read(root))
        files = {e.get("id"): e.get("href") for e in package.iter() if e.tag.endswith("}item")}
        base = PurePosixPath(root).parent
        out = []
        for ref in (e.get("idref") for e in package.iter() if e.tag.endswith("}itemref")):
            title, text = page(decoded(z.read(str(base / files[ref]))))
            out += [section(s["title"], s["text"], 0, s["title"]) for s in split_markdown(text, title)]
    return [s for s in out if len(s["text"].split()) > EPUB_WORDS]


EXTRACTORS: dict[str, Callable[[str, bytes], list[Section]]] = {"text": extract_text, "code": extract_code, "epub": extract_epub}


def read_documents(spark: SparkSession, folder: str, extractors: dict[str, Callable[[str, bytes], list[Section]]] | None = None) -> DataFrame:
    """path, source_type, sections and error of every file under a folder, by extension.

    Types without an extractor (PDF, audio, unless one is given) and files that fail have an error and no sections. Folders of tools and builds are skipped.
    """
    known = {**EXTRACTORS, **(extractors or {})}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", T.source_type_of(F.col("path")).alias("source_type"), "content")
    skipped = "/(" + "|".join(re.escape(x) for x in sorted(SKIPPED)) + ")/"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("title", pa.string()), ("text", pa.string()), ("page_num", pa.int32()), ("chapter", pa.string())]))
        for b in batches:
            found, errors = [], []
            for path, source_type, data in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    found.append(known[source_type](path, data))
                    errors.append(None)
                except Exception as e:  # one bad file mustn't end the others
                    found.append([])
                    errors.append(f"{type(e).__name__}: {e}"[:500])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, kind), pa.array(errors, pa.string())], names=["path", "source_type", "sections", "error"])

    return files.where(~F.col("path").rlike(skipped)).mapInArrow(run, f"path string, source_type string, sections {SECTIONS}, error string")


def pages(df: DataFrame, key: str, markup: str) -> DataFrame:
    """key, title and sections of each row's HTML; null markup has none."""
    kind = pa.list_(pa.struct([("title", pa.string()), ("text", pa.string()), ("page_num", pa.int32()), ("chapter", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [extract_page(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in found], pa.string()), pa.array([s for _, s in found], kind)], names=["key", "title", "sections"])

    return df.select(F.col(key).alias("key"), markup).mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, title string, sections {SECTIONS}")
