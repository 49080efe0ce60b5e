"""Text files of ``key := value`` lines: image headers and job parameters, and small tables of frames, gates and plasma samples."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LINE = re.compile(r"^\s*([^;:=\[]+?)\s*(?:\[\s*(\d+)\s*\])?\s*:=\s*(.*?)\s*$")


def text_of(spark: SparkSession, path: str) -> str:
    """A small text file, read by Spark so that any store will do."""
    rows = spark.read.text(path, wholetext=True).take(1)
    return rows[0][0] if rows else ""


def keyword(text: str) -> str:
    """Lower case, without a leading exclamation mark, blanks and underscores as one blank."""
    return re.sub(r"[\s_]+", " ", text.strip().lstrip("!")).strip().lower()


def entries(text: str) -> list[tuple[str, int | None, str]]:
    """(keyword, index or None, value) of each line in order; comments begin with a semicolon; a backslash goes on in the next line."""
    found = []
    for line in re.sub(r"\\\r?\n", "", text).splitlines():
        if not line.strip().startswith(";") and (m := _LINE.match(line)):
            found.append((keyword(m[1]), int(m[2]) if m[2] else None, m[3]))
    return found


def header(text: str) -> dict[str, str | dict[int, str]]:
    """Keywords with their last value; indexed ones as {index: value}."""
    out: dict = {}
    for key, index, value in entries(text):
        if index is None:
            out[key] = value
        else:
            known = out.get(key)
            out[key] = (known if isinstance(known, dict) else {}) | {index: value}
    return out


def values(text: str) -> list[float]:
    """A list ``{1, 2, 3}`` or one number."""
    return [float(v) for v in text.strip().strip("{}").split(",") if v.strip()]


def time_frames(text: str) -> list[tuple[float, float]]:
    """(start, end) in seconds from lines ``number duration``; number 0 skips the duration."""
    at, found = 0.0, []
    for line in text.splitlines():
        if not (parts := line.split()):
            continue
        number, duration = int(parts[0]), float(parts[1])
        if number < 0 or duration < 0:
            raise ValueError(f"negative frame: {line}")
        for _ in range(max(1, number)):
            if number:
                found.append((at, at + duration))
            at += duration
    return found


def plasma_samples(spark: SparkSession, path: str) -> DataFrame:
    """t_s, plasma, blood; the first line of the file has the number of samples."""
    lines = [line.split() for line in text_of(spark, path).splitlines() if line.strip()]
    rows = [tuple(float(v) for v in line[:3]) for line in lines[1:]]
    if lines and int(lines[0][0]) != len(rows):
        raise ValueError(f"{path}: {lines[0][0]} samples announced, {len(rows)} found")
    return spark.createDataFrame(rows, "t_s double, plasma double, blood double")


def read_gates(spark: SparkSession, path: str) -> DataFrame:
    """Gate definitions: rows ``gate duration`` with seq, their place in the file; gate 0 is a gap."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "text")).withColumn("text", F.trim("text")).filter("text <> ''")
    part = F.split("text", r"\s+")
    rows = lines.select("line", part[0].cast("int").alias("gate"), part[1].cast("double").alias("duration_s"))
    bad = (F.col("gate").isNull()) | F.col("duration_s").isNull() | (F.col("gate") < 0) | ((F.col("gate") > 0) & (F.col("duration_s") < 0))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not a gate and its duration in line "), F.col("line") + 1)).cast("int")).otherwise(F.col("gate"))
    return rows.select(F.col("line").alias("seq"), checked.alias("gate"), "duration_s")
