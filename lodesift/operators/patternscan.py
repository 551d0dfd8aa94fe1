"""Line scans: texts cut into lines, each line against a table of patterns, hits masked.

Patterns are literals of the plan, so each compiles once a task, and all run in one pass over the lines
without a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.functions import dims
from lodesift.operators.order import with_place


def lines(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, ``line`` (from 1), ``text``: the lines of a text, whatever ends them.

    A line end at the very end opens no further line; an empty text has no line, a null one neither.
    """
    cut = F.split(F.col(text), r"\r\n|\r|\n")
    whole = F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)
    rows = df.filter(F.length(text) > 0).select(*keys, F.posexplode(whole).alias("_n", "_t"))
    return rows.select(*keys, (F.col("_n") + 1).alias("line"), F.col("_t").alias("text"))


def is_test_path(path: Column) -> Column:
    low = F.lower(path)
    folder = F.arrays_overlap(F.split(F.replace(low, F.lit("\\"), F.lit("/")), "/"), F.array(*[F.lit(x) for x in dims.TEST_FOLDERS]))
    ending = F.lit(False)
    for e in dims.TEST_ENDINGS:
        ending = ending | low.endswith(e)
    return folder | ending


def is_source_path(path: Column) -> Column:
    """Whether the suffix, case counting, is one of source files."""
    return path.rlike("[^/](" + "|".join(map(re.escape, dims.SOURCE_SUFFIXES)) + ")$")


def in_left_out_folder(path: Column, more: list[str] = ()) -> Column:
    """Whether a folder on the way is one of those left out, or a cache."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(folders, lambda x: x.isin(*dims.LEFT_OUT_FOLDERS, *more) | x.startswith(".cache"))


def masked_line(text: Column, most: int = 500) -> Column:
    """A line with quoted literals of 12 characters or more and assigned secrets masked, cut to ``most``."""
    # The two patterns and what stands for a match.
    plain = F.regexp_replace(text, r"""(['"])[A-Za-z0-9+/=_-]{12,}\1""", "$1<redacted-long-literal>$1")
    plain = F.regexp_replace(plain, r"""(?i)(key|secret|password|token|passphrase)\s*[:=]\s*(['"])[^'"]+\2""", "$1=<redacted>")
    return F.when(F.length(plain) > most, F.concat(F.left(plain, F.lit(most - 3)), F.lit("..."))).otherwise(plain)


def pattern_hits(rows: DataFrame, text: str, patterns: list[tuple[str, str, str, str]]) -> DataFrame:
    """Each line with each pattern it matches: adds ``pattern_ord``, ``category``, ``severity_hint``, ``note``."""
    found = F.array(*[F.when(F.col(text).rlike(rx), F.struct(F.lit(k).alias("pattern_ord"), F.lit(c).alias("category"), F.lit(s).alias("severity_hint"), F.lit(n).alias("note"))) for k, (c, s, rx, n) in enumerate(patterns)])
    return rows.withColumn("_hit", F.explode(F.array_compact(found))).select(*rows.columns, "_hit.*")


def static_scan(sources: DataFrame, path: str, text: str, most_length: int = 500, leave_out: list[str] = (), all_text: bool = False) -> DataFrame:
    """Lines of source files that match the scan's patterns, masked: path, line, category, severity_hint, test_path, note, excerpt.

    Files are chosen by suffix, or all of them with ``all_text``; folders of builds and caches are left out,
    and those named in ``leave_out``. Two rows of the same path are two files.
    """
    chosen = sources.filter(~in_left_out_folder(F.col(path), list(leave_out)) & (F.lit(all_text) | is_source_path(F.col(path))))
    hits = pattern_hits(lines(chosen, [path], text), "text", dims.PATTERNS)
    shown = F.regexp_replace(masked_line(F.col("text"), most_length), r"(?U)^\s+|\s+$", "")
    return hits.select(F.col(path).alias("path"), "line", "pattern_ord", "category", "severity_hint", is_test_path(F.col(path)).alias("test_path"), "note", shown.alias("excerpt"))


def capped(hits: DataFrame, most: int) -> DataFrame:
    """The first ``most`` hits by path, line and pattern (0: all); the cap is a feature of the report."""
    if most < 0:
        raise ValueError("the cap must not be negative")
    return hits.orderBy("path", "line", "pattern_ord").limit(most) if most else hits


def in_report_order(hits: DataFrame) -> DataFrame:
    """Hits by category, path, line and pattern, with their ``place`` from 1."""
    return with_place(hits, ["category", "path", "line", "pattern_ord"], "place")


def pack_hits(rows: DataFrame, text: str) -> DataFrame:
    """Each line with each search pack it matches: adds ``pack``."""
    found = F.array(*[F.when(F.col(text).rlike(rx), F.lit(name)) for name, rx in dims.SEARCH_PACKS])
    return rows.withColumn("pack", F.explode(F.array_compact(found)))


def boundary_scan(sources: DataFrame, path: str, text: str) -> DataFrame:
    """Rust lines by section of the boundary scan: path, line, section_ord, section, text."""
    allowed = ~F.col(path).rlike(r"^(target|vendor|third_party)/|(^|/)\.git/")
    rows = lines(sources.filter(allowed & F.col(path).rlike(r"\.(rs|toml|yaml|yml)$|\.env[^/]*$")), [path], text)
    found = F.array(*[
        F.when(F.col(path).rlike(dims.RUST_SECTION_FILES.get(name, r"\.rs$")) & F.col("text").rlike(rx), F.struct(F.lit(k).alias("section_ord"), F.lit(name).alias("section")))
        for k, (name, rx) in enumerate(dims.RUST_SECTIONS)
    ])
    return rows.withColumn("_s", F.explode(F.array_compact(found))).select(F.col(path).alias("path"), "line", "_s.*", "text")


def counts_by(hits: DataFrame, column: str) -> DataFrame:
    return hits.groupBy(column).agg(F.count("*").alias("hits"))
