"""Subtitles and transcripts as timed segments, and back."""

from __future__ import annotations

import re

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import chunking

Segment = tuple[float, float, str]
_CLOCK = r"(\d+):(\d{2}):(\d{2})[,.](\d{1,3})"
_SRT = re.compile(rf"{_CLOCK}\s*-->\s*{_CLOCK}")
_TXT = re.compile(r"^\[(\d+):(\d{2}) - (\d+):(\d{2})\]\s*(.*)$", re.M)


def clock(seconds: float) -> str:
    """HH:MM:SS,mmm."""
    ms = round(seconds * 1000)
    return f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d},{ms % 1000:03d}"


def parse_srt(text: str | None) -> list[Segment]:
    """Segments of a subtitle file; lines of a block are joined by spaces; blocks without a time or a text are skipped."""
    out = []
    for block in re.split(r"\r?\n\s*\r?\n", text or ""):
        m = _SRT.search(block)
        words = " ".join(x.strip() for x in block[m.end() :].splitlines() if x.strip()) if m else ""
        if words:
            h = [int(x) for x in m.groups()]
            out.append((h[0] * 3600 + h[1] * 60 + h[2] + h[3] / 1000, h[4] * 3600 + h[5] * 60 + h[6] + h[7] / 1000, words))
    return out


def format_srt(segments: list[Segment]) -> str:
    return "\n".join(f"{i}\n{clock(a)} --> {clock(b)}\n{t}\n" for i, (a, b, t) in enumerate(segments, 1))


def parse_txt(text: str | None) -> list[Segment]:
    """Segments of lines "[M:SS - M:SS] text"; other lines are skipped."""
    return [(int(a) * 60.0 + int(b), int(c) * 60.0 + int(d), t) for a, b, c, d, t in _TXT.findall(text or "")]


def format_txt(segments: list[Segment]) -> str:
    return "\n".join(f"[{int(a) // 60}:{int(a) % 60:02d} - {int(b) // 60}:{int(b) % 60:02d}] {t}" for a, b, t in segments)


def read_srt(spark: SparkSession, folder: str) -> DataFrame:
    """path, episode_num (1-based place of the file in its folder), start, end and text of every block of the subtitle files, inside the JVM."""
    from pyspark.sql import Window

    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.srt").text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    blocks = files.select("path", F.posexplode(F.split("value", r"\r?\n\s*\r?\n")).alias("n", "block"))
    part = lambda k: F.regexp_extract("block", _SRT.pattern, k).cast("double")
    time = lambda k: part(k) * 3600 + part(k + 1) * 60 + part(k + 2) + part(k + 3) / 1000
    words = F.regexp_replace(F.btrim(F.regexp_replace(F.regexp_replace("block", r"(?s)^.*?-->[^\r\n]*", ""), r"\s*\r?\n\s*", " ")), " +", " ")
    rows = blocks.where(F.col("block").rlike(_SRT.pattern)).select("path", "n", time(1).alias("start"), time(5).alias("end"), words.alias("text")).where("text <> ''")
    folders = files.select("path").distinct().withColumn("episode_num", F.row_number().over(Window.partitionBy(F.regexp_replace("path", "[^/]*$", "")).orderBy("path")))
    return rows.join(folders, "path").select("path", "episode_num", "start", "end", "text")


def media_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, episode_num (place in the folder, from 1, by name), episode_title and srt_path (null without a subtitle file of that name) of the audio and video files of a folder. Contents aren't read."""
    from pyspark.sql import Window

    files = spark.read.format("binaryFile").load(folder).select("path")
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    media = files.where(T.source_type_of(F.col("path")) == "audio").select("path", stem.alias("stem"))
    subtitles = files.where(F.lower("path").endswith(".srt")).select(stem.alias("stem"), F.col("path").alias("srt_path"))
    number = F.row_number().over(Window.partitionBy(F.regexp_replace("path", "[^/]*$", "")).orderBy("path"))
    return media.withColumn("episode_num", number).join(subtitles, "stem", "left").select("path", "episode_num", F.regexp_extract("stem", "[^/]*$", 0).alias("episode_title"), "srt_path")


def windows(duration: float, size: float = 30.0) -> list[tuple[float, float]]:
    """The stretches of a recording that are transcribed one at a time: ``size`` seconds each, the last shorter."""
    n = max(0, -int(-duration // size))
    return [(k * size, min(duration, (k + 1) * size)) for k in range(n)]


def transcribed(duration: float, recognise: Callable[[float, float], str], size: float = 30.0) -> list[Segment]:
    """Segments of a recording by a speech model over its windows; silent ones are left out. If all are, the whole is tried once more."""
    found = [(a, b, t) for a, b in windows(duration, size) if (t := (recognise(a, b) or "").strip())]
    if found or duration <= 0:
        return found
    whole = (recognise(0.0, duration) or "").strip()
    return [(0.0, duration, whole)] if whole else []


def ingest_srt(spark: SparkSession, folder: str, collection: str, topic: str = "", subtopic: str = "", source_type: str = "video") -> DataFrame:
    """Chunks of a folder of subtitle files: a file is an episode, in the order of names, cut into overlapping windows; topics are in lower case, the url is the file's path."""
    rows = read_srt(spark, folder)
    found = chunking.chunk_segments(rows, ["path", "episode_num"], "start", "end", "text", [])
    title = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
    at = F.col("start_sec").cast("int")
    return found.select(F.lit(sanitized(collection)).alias("collection"), F.lit(collection).alias("collection_display"), F.lit(topic.lower()).alias("topic"), F.lit(subtopic.lower()).alias("subtopic"), "episode_num", title.alias("episode_title"), F.col("path").alias("url"),
        F.lit(source_type).alias("source_type"), "chunk_index", "text", at.alias("start_sec"), F.col("end_sec").cast("int").alias("end_sec"), F.when(at > 0, T.fmt_timestamp(at)).otherwise("").alias("time_label"), T.content_hash(F.col("text")).alias("content_hash"))


def sanitized(name: str) -> str:
    """``text.sanitize`` of a name."""
    plain = re.sub(r'[<>:"/\\|?*\x00-\x1f]', "", name).strip()
    return re.sub(r"\s+", "_", plain)[:80]
