"""SRT and WebVTT captions: parsed from whole files, one row a file, and encoded back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TIME = r"([0-9]{2,}):([0-5][0-9]):([0-5][0-9])[,.]([0-9]{3})"
_LINE = rf"{_TIME}[\x20\x09]+-->[\x20\x09]+{_TIME}"


def _ms(line: Column, first: int) -> Column:
    part = lambda k: F.regexp_extract(line, _LINE, first + k).cast("long")
    return ((part(0) * 60 + part(1)) * 60 + part(2)) * 1000 + part(3)


def parse_srt(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per cue: the file's id, cue (from 1), start, stop (milliseconds), text; blocks without a time line are left out."""
    text = F.regexp_replace(F.regexp_replace(F.col(text_col), "^﻿", ""), "\r\n?", "\n")
    block = files.select(F.col(id_col), F.posexplode(F.filter(F.split(text, r"\n[\x20\x09]*\n+"), lambda b: b.rlike(_LINE))).alias("i", "b"))
    line = F.regexp_extract("b", f"({_LINE}[^\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("b", rf"(?s)^.*?{_LINE}[^\n]*\n?", ""), r"\s+$", "")
    return block.select(id_col, (F.col("i") + 1).alias("cue"), _ms(line, 1).alias("start"), _ms(line, 5).alias("stop"), body.alias("text"))


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return parse_srt(files, "file", "text")


def stamp(ms: Column) -> Column:
    part = lambda n, m, w: F.lpad((F.floor(ms / n) % m).cast("string"), w, "0")
    return F.concat(F.lpad(F.floor(ms / 3_600_000).cast("string"), 2, "0"), F.lit(":"), part(60_000, 60, 2), F.lit(":"), part(1000, 60, 2), F.lit(","), part(1, 1000, 3))


def encode_srt(cues: DataFrame, keys: list[str]) -> DataFrame:
    """A row per key with its cues as an SRT text, in order of start, stop and cue."""
    one = F.concat(stamp(F.col("start")), F.lit(" --> "), stamp(F.col("stop")), F.lit("\n"), F.col("text"), F.lit("\n"))
    rows = F.sort_array(F.collect_list(F.struct("start", "stop", "cue", one.alias("s"))))
    return cues.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r, i: F.concat((i + 1).cast("string"), F.lit("\n"), r["s"])), "\n").alias("srt"))


_VTT_TIME = r"(?:([0-9]{2,}):)?([0-5][0-9]):([0-5][0-9])\.([0-9]{3})"
_VTT_LINE = rf"{_VTT_TIME}[\x20\x09]+-->[\x20\x09]+{_VTT_TIME}"


def parse_vtt(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per cue of WebVTT texts: id, cue (from 1), start, stop (milliseconds), speaker (of the first voice span, or null), text.

    Notes, styles and regions are left out, as are blocks without a time line; tags go, and character references are read.
    A text whose first line is not WEBVTT has no cues."""
    text = F.regexp_replace(F.regexp_replace(F.col(text_col), "^\ufeff", ""), "\r\n?", "\n")
    known = F.when(text.rlike(r"^WEBVTT(?:[\x20\x09\n]|\z)"), text)
    timed = F.filter(F.split(known, r"\n[\x20\x09]*\n+"), lambda b: b.rlike(_VTT_LINE) & ~b.rlike(r"^(?:NOTE|STYLE|REGION)(?:[\x20\x09\n]|\z)"))
    block = files.select(F.col(id_col), F.posexplode(timed).alias("i", "b"))
    line = F.regexp_extract("b", f"({_VTT_LINE}[^\n]*)", 1)
    part = lambda k: F.coalesce(F.try_to_number(F.regexp_extract(line, _VTT_LINE, k), F.lit("9999999")), F.lit(0)).cast("long")
    ms = lambda k: ((part(k) * 60 + part(k + 1)) * 60 + part(k + 2)) * 1000 + part(k + 3)
    raw = F.regexp_replace(F.regexp_replace("b", rf"(?s)^.*?{_VTT_LINE}[^\n]*\n?", ""), r"\s+$", "")
    body = F.regexp_replace(raw, "<[^>\n]*>", "")
    for name, sign in (("lt", "<"), ("gt", ">"), ("nbsp", "\u00a0"), ("amp", "&")):
        body = F.replace(body, F.lit(f"&{name};"), F.lit(sign))
    speaker = F.nullif(F.trim(F.regexp_extract(raw, r"<v(?:\.[^\x20\x09>]*)?[\x20\x09]+([^>\n]+)>", 1)), F.lit(""))
    return block.select(id_col, (F.col("i") + 1).alias("cue"), ms(1).alias("start"), ms(5).alias("stop"), speaker.alias("speaker"), body.alias("text"))


def encode_vtt(cues: DataFrame, keys: list[str]) -> DataFrame:
    """A row per key with its cues as a WebVTT text, in order of start, stop and cue; speaker may be null."""
    text = F.col("text")
    for sign, name in (("&", "amp"), ("<", "lt"), (">", "gt")):
        text = F.replace(text, F.lit(sign), F.lit(f"&{name};"))
    voice = F.when(F.col("speaker").isNull(), "").otherwise(F.concat(F.lit("<v "), F.col("speaker"), F.lit(">")))
    time = lambda c: F.replace(stamp(F.col(c)), F.lit(","), F.lit("."))
    one = F.concat(F.lit("\n"), time("start"), F.lit(" --> "), time("stop"), F.lit("\n"), voice, text, F.lit("\n"))
    rows = F.sort_array(F.collect_list(F.struct("start", "stop", "cue", one.alias("s"))))
    return cues.groupBy(*keys).agg(F.concat(F.lit("WEBVTT\n"), F.array_join(F.transform(rows, lambda r: r["s"]), "")).alias("vtt"))
