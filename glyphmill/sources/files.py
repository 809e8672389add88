"""Text files as documents, and rule files as tables."""

from __future__ import annotations

import re
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.text import content_type
from glyphmill.operators.lexical import RULES

#: Bytes that a file may have, and extensions of text files.
MOST_BYTES = 16 << 20
EXTENSIONS = ("md", "markdown", "yml", "yaml", "txt")


def glob_pattern(glob: str) -> str:
    """A path glob as a pattern: ``*`` within a part, ``**`` across parts, ``?`` one character, ``[...]`` a class.

    A glob without a slash fits any part of a path, one that ends in a slash everything below such a folder.
    """
    out, i = "", 0
    body = glob.rstrip("/")
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and "]" in body[i:]:
            end = body.index("]", i)
            inner = body[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]", end + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return ("" if body.startswith("/") else "(^|.*/)") + out + ("/.*" if glob.endswith("/") else "(/.*)?") + "$"


def excluded(path: Column, globs: list[str]) -> Column:
    """Whether a path (relative to its root) fits one of the globs."""
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike("^" + glob_pattern(g))
    return out


def scan_files(spark: SparkSession, path: str, exclude: list[str] | None = None) -> DataFrame:
    """``path, text, content_type, size, too_large, unreadable`` of the text files below ``path``, hidden ones left out.

    Files beyond MOST_BYTES, and files that aren't UTF-8, have no text; their contents are read only if they may have.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").load(path)
    # What counts is the path below the root, which may itself lie under a hidden folder.
    root = re.sub(r"^[a-z0-9+.\-]+:/+", "/", path.rstrip("/"))
    below = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9+.\-]+:/+", "/"), "^.*?" + re.escape(root) + "/", "")
    files = files.withColumn("_below", below).where(~F.col("_below").rlike(r"(^|/)\."))
    if exclude:
        files = files.where(~excluded(F.col("_below"), exclude))
    files = files.withColumn("too_large", F.col("length") > MOST_BYTES)
    text = F.when(~F.col("too_large"), F.try_validate_utf8(F.col("content").cast("string")))
    return files.select("path", text.alias("text"), content_type(F.col("path")).alias("content_type"), F.col("length").alias("size"), "too_large").withColumn("unreadable", ~F.col("too_large") & F.col("text").isNull())


def changed(files: DataFrame, paths: list[str]) -> DataFrame:
    """Those of ``files(path)`` that a list of changed paths, relative to any root, names."""
    names = files.sparkSession.createDataFrame([(p.lstrip("./"),) for p in paths], "name string").distinct()
    own = files.withColumn("_parts", F.split("path", "/")).withColumn("_suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size("_parts")), lambda n: F.array_join(F.slice("_parts", -n, n), "/"))))
    hit = own.join(F.broadcast(names), own._suffix == names.name, "left_semi").select("path").distinct()
    return files.join(hit, "path", "left_semi")


def from_stream(spark: SparkSession, stream=None, name: str = "-", most: int = MOST_BYTES) -> DataFrame:
    """One document from standard input (or another byte stream): ``path, text, content_type, size, too_large, unreadable``."""
    data = (stream or sys.stdin.buffer).read(most + 1)
    text = None
    if len(data) <= most:
        try:
            text = data.decode()
        except UnicodeDecodeError:
            pass
    row = (name, text, "plain", len(data), len(data) > most, len(data) <= most and text is None)
    return spark.createDataFrame([row], "path string, text string, content_type string, size long, too_large boolean, unreadable boolean")


def rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from JSON lines, with the fixed schema; nothing is inferred."""
    return spark.read.schema(RULES).json(path)
