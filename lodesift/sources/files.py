"""File sources and sinks: source trees, JSON findings, reports."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesift.operators.nested import complete_json, json_list
from lodesift.operators.patternscan import in_left_out_folder, is_source_path

FINDING = """id STRING, finding_id STRING, title STRING, severity STRING, confidence STRING, status STRING, audit_skill STRING, surface STRING, dedupe_key STRING,
affected_claims ARRAY<STRING>, evidence ARRAY<STRUCT<type: STRING, description: STRING, file: STRING, location: STRING, excerpt: STRING>>, impact STRING, severity_rationale STRING,
recommended_fix STRING, retest_steps ARRAY<STRING>, reproduction_steps ARRAY<STRING>, limitations ARRAY<STRING>, source_ids ARRAY<STRING>, source_skills ARRAY<STRING>, affected_skills_to_rerun ARRAY<STRING>,
boundary_surface STRING, crypto_surface STRING, metadata_surface STRING, risk_rationale STRING, remediation STRING, duplicate_key STRING, root_cause_hypothesis STRING,
fix_commits ARRAY<STRING>, retest_evidence ARRAY<STRING>, status_history ARRAY<STRING>"""


def read_sources(spark: SparkSession, root: str, leave_out: list[str] = (), all_text: bool = False) -> DataFrame:
    """``path`` below ``root`` and ``text`` of source files; bytes that are no UTF-8 are replaced.

    Folders of builds and caches are left out. Files are chosen by suffix; with ``all_text`` also others
    without a NUL in the first 2048 bytes. The filters on the path need no file contents.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = "file:" + str(Path(root).resolve()) if "://" not in root else root.rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "file:/"), f"^{base}/", "")
    rows = files.withColumn("rel", path).filter(~in_left_out_folder(F.col("rel"), leave_out))
    named = is_source_path(F.col("rel"))
    no_nul = ~F.hex(F.substring("content", 1, 2048)).rlike("^(?:..)*00")
    rows = rows.filter(named | (F.lit(all_text) & no_nul))
    return rows.select(F.col("rel").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def findings_of(text: Column) -> Column:
    """The findings of a JSON document, as JSON texts: an object, a list, or an object with ``findings``.

    A document that is no complete JSON is null; an element that is no object stays as null.
    """
    doc = complete_json(text)
    inner = F.get_json_object(doc, "$.findings")
    items = F.when(inner.startswith("["), json_list(inner)).otherwise(json_list(doc))
    return F.transform(items, lambda x: F.when(x.startswith("{"), x))


def read_findings(spark: SparkSession, paths: list[str] | str, strict: bool = True) -> DataFrame:
    """Findings of JSON files, one file a document; ``file``, ``at`` and the members of a finding.

    With ``strict`` a document or an element that is no finding is an error, else it is left out.
    """
    texts = spark.read.format("text").option("wholetext", "true").load(paths).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    rows = texts.select("file", findings_of(F.col("value")).alias("_fs"))
    if strict:
        bad = F.col("_fs").isNull() | F.exists("_fs", lambda x: x.isNull())
        rows = rows.withColumn("_fs", F.when(bad, F.raise_error(F.concat(F.lit("no findings document: "), F.col("file"))).cast("array<string>")).otherwise(F.col("_fs")))
    flat = rows.select("file", F.posexplode("_fs").alias("at", "_f")).filter(F.col("_f").isNotNull())
    return _members(flat, ["file", "at"], "_f")


def _members(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The members of a finding's JSON text; a list's member that is no list counts as a list of one."""
    kinds = dict(x.strip().split(" ", 1) for x in re.split(r",(?![^<]*>)\s*", FINDING))
    read = rows.select(*keys, F.from_json(text, ", ".join(f"{n} STRING" for n in kinds)).alias("f"))

    def listed(c: Column, kind: str) -> Column:
        items = F.when(c.startswith("["), F.from_json(c, kind))
        return items.when(c.isNotNull(), F.array(F.from_json(c, kind[6:-1]) if "STRUCT" in kind else c))

    members = [(listed(F.col(f"f.{n}"), k) if k.startswith("ARRAY") else F.col(f"f.{n}")).alias(n) for n, k in kinds.items()]
    return read.select(*keys, *members).withColumn("finding_id", F.coalesce("finding_id", "id"))


def read_register(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Records of register documents, in their order: ``file``, ``at`` and the members of a finding.

    A document that is no object with a list of ``findings`` is an error.
    """
    texts = spark.read.format("text").option("wholetext", "true").load(paths).select(F.col("_metadata.file_path").alias("file"), complete_json(F.col("value")).alias("_d"))
    inner = F.get_json_object("_d", "$.findings")
    shape = F.coalesce(F.col("_d").startswith("{") & inner.startswith("["), F.lit(False))
    records = F.when(shape, json_list(inner)).otherwise(F.raise_error(F.concat(F.lit("no register: "), F.col("file"))).cast("array<string>"))
    flat = texts.select("file", F.posexplode(records).alias("at", "_f"))
    return _members(flat, ["file", "at"], "_f")


def read_har_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """HAR files, one row for each: ``artifact`` and ``har``, for parse_har."""
    return spark.read.format("text").option("wholetext", "true").load(paths).select(F.col("_metadata.file_path").alias("artifact"), F.col("value").alias("har"))


def write_json(df: DataFrame, folder: str, replace: bool = False) -> None:
    """Rows as JSON lines; an existing folder is an error unless it is to be replaced."""
    df.write.mode("overwrite" if replace else "errorifexists").json(folder)


def write_document(path: str, document: object, sort_keys: bool = True, replace: bool = False) -> None:
    """One small JSON document, such as a summary, by the driver; makes folders."""
    target = Path(path)
    if target.exists() and not replace:
        raise FileExistsError(f"{path} exists")
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(document, indent=2, sort_keys=sort_keys, default=str) + "\n", encoding="utf-8")


def markdown_table(names: list[str], rows: Iterable[Iterable[object]]) -> str:
    """A Markdown table of a few rows; line ends and bars in cells are escaped."""
    cell = lambda x: str("" if x is None else x).replace("\r", " ").replace("\n", " ").replace("|", "\\|")
    body = ["| " + " | ".join(map(cell, r)) + " |" for r in rows]
    return "\n".join(["| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *body])


def left_out(n: int) -> str:
    """The line below a table that tells how many rows it lacks; empty if none."""
    return f"\n\n{n} more rows are left out." if n > 0 else ""


def markdown_report(df: DataFrame, group: str | None = None, most_rows: int | None = None) -> str:
    """A report of a small result: one table, or one for each value of ``group``, sorted.

    Whole by default; with ``most_rows`` its first rows by group and the other columns, and how many are
    left out.
    """
    if most_rows is None:
        rows, more = df.collect(), ""
    else:
        rows = df.orderBy(*([group] if group else []), *[c for c in df.columns if c != group]).limit(most_rows).collect()
        more = left_out(df.count() - len(rows))
    names = [c for c in df.columns if c != group]
    if not group:
        return markdown_table(names, [[r[n] for n in names] for r in rows]) + more + "\n"
    parts = []
    for value in sorted({str(r[group]) for r in rows}):
        parts.append(f"## {value}\n\n" + markdown_table(names, [[r[n] for n in names] for r in rows if str(r[group]) == value]))
    return "\n\n".join(parts) + more + "\n"


def gate(df: DataFrame) -> int:
    """1 if there is any row, else 0: an exit code for checks that fail on findings."""
    return int(not df.isEmpty())


def skill_catalog(spark: SparkSession, root: str, without: list[str] = ()) -> DataFrame:
    """``skill`` and ``path`` of the skills below a folder, sorted, those of ``without`` left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "SKILL.md").load(root)
    found = files.select(F.regexp_extract("path", r"/skills/([^/]+)/SKILL\.md$", 1).alias("skill"), "path").filter("skill <> ''")
    return found.filter(~F.col("skill").isin(list(without))).orderBy("skill", "path") if without else found.orderBy("skill", "path")
