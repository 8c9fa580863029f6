"""Text functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions of each source type; others are text.
EXTENSIONS = {
    "pdf": "pdf",
    "epub": "epub",
    "text": "md txt rst html htm",
    "code": "py js ts tsx jsx java go rs cpp c cs rb php",
    "audio": "mp3 wav m4a flac ogg aac wma mp4 mkv avi mov webm",
}
# What disqualifies a heading.
BAD_HEADING = r"(?i)^\d+$|^https?://|^[/\\]|\.{3,}|^\w+\.\w+\(|^import |^from |^def |^class "
#: Words of a chunk for a number of tokens.
WORDS_PER_TOKEN = 0.75


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def words(c: Column) -> Column:
    """The pieces between runs of white space; a blank text has none."""
    return F.filter(F.split(strip(c), r"\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(c) / 4).cast("int")


def content_hash(c: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of the text."""
    return F.substring(F.sha2(c, 256), 1, 16)


def slug(c: Column, most: int = 30) -> Column:
    """Lower-case letters and digits of ASCII, all else as single underscores, none at the ends."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.regexp_replace(F.substring(s, 1, most), "_+$", "")


def sanitize(c: Column, most: int = 80) -> Column:
    """A file name: forbidden and control characters dropped, white space as underscores."""
    s = F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "")
    return F.substring(F.regexp_replace(strip(s), r"\s+", "_"), 1, most)


def fmt_timestamp(seconds: Column) -> Column:
    """MM:SS; minutes go on past 59."""
    s = seconds.cast("int")
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("int"), F.pmod(s, F.lit(60)))


def deep_link(url: Column, start: Column) -> Column:
    """The URL of a video page with its start time."""
    video = url.contains("youtube.com") | url.contains("youtu.be") | url.contains("bilibili.com")
    sep = F.when(url.contains("?"), "&").otherwise("?")
    return F.when(video & (start > 0), F.concat(url, sep, F.lit("t="), start.cast("string"))).otherwise(url)


def source_type_of(path: Column) -> Column:
    """The source type of a path by its extension."""
    ext = F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))
    found = F.lit("text")
    for kind, all_ in EXTENSIONS.items():
        found = F.when(ext.isin(all_.split()), kind).otherwise(found)
    return found


def valid_heading(title: Column) -> Column:
    """Whether a line can be a heading: not long, not a number, link, path, dot leader, code or long sentence."""
    sentence = title.endswith(".") & title.contains(" ") & (word_count(title) > 5)
    return (F.length(title) > 0) & (F.length(title) <= 80) & ~title.rlike(BAD_HEADING) & ~sentence


def clean_title(title: Column) -> Column:
    """Without a page number at its end."""
    return strip(F.regexp_replace(title, r"\s*\d+\s*$", ""))


def _pad(c: Column, n: int) -> Column:
    return F.format_string(f"%0{n}d", c.cast("int"))


def chunk_id(index: Column) -> Column:
    """The id of a chunk from the columns of the chunk table, by source type."""
    c = {k: F.col(k) for k in ("source_type", "chapter", "section_heading", "page_num", "line_start", "line_end", "start_sec", "episode_title", "episode_num", "file_path")}
    base, order = slug(F.col("collection")), _pad(index, 4)
    nth = F.concat(F.lit("s"), _pad(index, 3))
    span = F.concat(F.lit("_L"), c["line_start"].cast("string"), F.lit("-"), c["line_end"].cast("string"))

    chapter = F.coalesce(F.nullif(c["chapter"], F.lit("")), F.nullif(c["section_heading"], F.lit("")))
    epub = F.concat(base, F.lit("_ch_"), F.when(chapter.isNull(), nth).otherwise(slug(chapter, 20)), F.lit("_"), order)
    section = F.coalesce(F.nullif(c["section_heading"], F.lit("")), F.nullif(c["chapter"], F.lit("")))
    section = F.when(section.isNull() | section.isin("(untitled)", "(preamble)"), "").otherwise(slug(section, 20))
    page = F.when(c["page_num"] > 0, F.concat(F.lit("p"), c["page_num"].cast("string"))).otherwise("")
    place = F.coalesce(F.nullif(section, F.lit("")), F.nullif(page, F.lit("")), nth)
    pdf = F.concat(base, F.lit("_"), place, F.lit("_"), order, F.when(c["line_start"] > 0, span).otherwise(""))
    minute = F.concat(F.lit("_t"), _pad(F.floor(c["start_sec"] / 60), 2), F.lit("m"), _pad(F.pmod(c["start_sec"], F.lit(60)), 2), F.lit("s"))
    name = F.coalesce(F.nullif(slug(c["episode_title"], 20), F.lit("")), F.concat(F.lit("ep"), _pad(c["episode_num"], 3)))
    media = F.concat(base, F.lit("_"), name, minute)
    code = F.concat(base, F.lit("_"), slug(F.translate(c["file_path"], "/.", "__"), 40), span)
    heading = F.nullif(c["section_heading"], F.lit(""))
    web = F.concat(base, F.lit("_"), F.when(heading.isNull(), nth).otherwise(slug(heading, 20)), F.lit("_"), order)
    t = c["source_type"]
    return F.when(t == "epub", epub).when(t == "pdf", pdf).when(t.isin("video", "audio"), media).when(t == "code", code).when(t == "web", web).otherwise(F.concat(base, F.lit("_"), order))


def tag_list(c: Column) -> Column:
    """The items of a comma-joined list: trimmed, lower-cased, blanks dropped."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda t: F.lower(strip(t))), lambda t: t != "")


def query_lines(reply: Column, most: int = 4) -> Column:
    """Sub-queries in a model's reply: one a line, without numbering and quotes, longer than five characters, at most ``most``."""
    lines = F.transform(F.split(strip(reply), r"\r\n|\r|\n"), lambda x: F.regexp_replace(strip(F.regexp_replace(x, r"^\s*\d+[.):\-]\s*", "")), r"^\"+|\"+$", ""))
    return F.slice(F.filter(F.transform(lines, lambda x: F.regexp_replace(x, "^'+|'+$", "")), lambda x: F.length(x) > 5), 1, most)


def html_text(html: Column) -> Column:
    """The text of a page: script, style, nav, footer and header dropped, tags as line breaks, common entities decoded, blank lines dropped."""
    s = F.regexp_replace(html, r"(?is)<(script|style|nav|footer|header)\b.*?</\1\s*>", "")
    s = F.regexp_replace(s, r"(?s)<!--.*?-->", "")
    s = F.regexp_replace(s, r"(?s)</?[a-zA-Z][^>]*>", "\n")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(plain))
    lines = F.filter(F.transform(F.split(s, "\n"), strip), lambda x: x != "")
    return F.array_join(lines, "\n")


def html_title(html: Column) -> Column:
    """The trimmed title of a page, empty if it has none."""
    return strip(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1))


def markdown_sections(text: Column) -> Column:
    """array<struct<title, text>> of a markdown text, cut at headers of one to three signs.

    What stands before the first header has an empty title; sections without text are dropped. One expression, no shuffle."""
    header = r"(?md)^#{1,3}[ \t\n\f\r]+(.*)"
    titles = F.concat(F.array(F.lit("")), F.transform(F.regexp_extract_all(text, F.lit(header), F.lit(1)), strip))
    bodies = F.transform(F.split(text, header), strip)
    zipped = F.arrays_zip(titles.alias("title"), bodies.alias("text"))
    return F.filter(F.transform(zipped, lambda z: F.struct(z["title"].alias("title"), z["text"].alias("text"))), lambda z: z["text"] != "")
