"""Queries over audit manifests, models and matrices: coverage, references, counts, graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.functions import dims
from lodesift.sources.tables import scratch, stored


def class_counts(rows: DataFrame, column: str, classes: DataFrame) -> DataFrame:
    """Rows of each class, zero for a class without any; ``classes`` has ``column``."""
    counts = rows.groupBy(column).agg(F.count("*").alias("rows"))
    return classes.join(counts, column, "left").fillna(0, ["rows"])


def exploded_counts(rows: DataFrame, column: str) -> DataFrame:
    """Rows that bear each item of a list column, an item counting once in a row."""
    return rows.select(F.explode(F.array_distinct(column)).alias(column)).groupBy(column).agg(F.count("*").alias("rows"))


def on_several(rows: DataFrame, field: str, surface: str, least: int = 2) -> DataFrame:
    """Fields seen on at least so many different surfaces."""
    return rows.groupBy(field).agg(F.count_distinct(surface).alias("surfaces")).filter(F.col("surfaces") >= least)


def without_match(rows: DataFrame, evidence: DataFrame, on: list[str]) -> DataFrame:
    """Rows nothing is mapped to: claims without evidence, flows without claim, ids listed but not defined."""
    return rows.join(evidence.select(*on).distinct(), on, "left_anti")


def with_match(rows: DataFrame, evidence: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(evidence.select(*on), on, "left_semi")


def orphans(rows: DataFrame, id_column: str, references: str, defined: DataFrame, defined_id: str) -> DataFrame:
    """References of a list column that no row defines: the owner and the reference."""
    listed = rows.select(id_column, F.explode(references).alias("reference"))
    return listed.join(defined.select(F.col(defined_id).alias("reference")).distinct(), "reference", "left_anti").select(id_column, "reference")


def crossing(flows: DataFrame, elements: DataFrame, exposed: list[str]) -> DataFrame:
    """Flows between elements of different zones whose encryption state is one of ``exposed``.

    ``flows`` has ``source``, ``destination``, ``encryption_state``; ``elements`` has ``element``, ``zone``.
    """
    a = elements.select(F.col("element").alias("source"), F.col("zone").alias("source_zone"))
    b = elements.select(F.col("element").alias("destination"), F.col("zone").alias("destination_zone"))
    return flows.join(a, "source").join(b, "destination").filter((F.col("source_zone") != F.col("destination_zone")) & F.col("encryption_state").isin(exposed))


def fan(edges: DataFrame, source: str, destination: str) -> DataFrame:
    """For each node how many different nodes it points to and is pointed to by."""
    out = edges.groupBy(F.col(source).alias("node")).agg(F.count_distinct(destination).alias("fan_out"))
    into = edges.groupBy(F.col(destination).alias("node")).agg(F.count_distinct(source).alias("fan_in"))
    return out.join(into, "node", "full").fillna(0, ["fan_out", "fan_in"])


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Nodes reachable from ``start`` along edges ``source``, ``destination``.

    Goes frontier by frontier until one is empty. Each is written once, into one table of what is known.
    """
    spark, folder, step = edges.sparkSession, scratch(edges.sparkSession), 0
    edges = stored(edges.select("source", "destination").distinct())
    ahead = starts.select(F.col("start"), F.col("start").alias("node")).distinct()
    kind = f"start {ahead.schema['start'].dataType.simpleString()}, node {ahead.schema['node'].dataType.simpleString()}"
    while True:
        ahead.write.parquet(f"{folder}/step={step}")
        known, frontier = (spark.read.schema(kind).parquet(p) for p in (folder, f"{folder}/step={step}"))
        if frontier.isEmpty():
            return known.select("start", "node")
        ahead = frontier.join(edges, frontier["node"] == edges["source"]).select("start", F.col("destination").alias("node")).distinct().join(known, ["start", "node"], "left_anti")
        step += 1


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """Nodes that lie on a cycle or between cycles: what is left when nodes without way in or out are taken off."""
    now = stored(edges.select("source", "destination").distinct())
    size = now.count()
    while True:  # each round takes edges off, or is the last
        inner = now.join(now.select(F.col("destination").alias("source")).distinct(), "source", "left_semi").join(now.select(F.col("source").alias("destination")).distinct(), "destination", "left_semi")
        now = stored(inner.select("source", "destination"))
        left = now.count()
        if left == size:
            return now.select(F.col("source").alias("node")).distinct()
        size = left


def distinct_counts(rows: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Different values of each column, one row for each; approximate ones in one pass without a shuffle of values."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    wide = rows.agg(*[count(c).alias(c) for c in columns])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("values")) for c in columns])).alias("_x")).select("_x.*")


def small_groups(rows: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Combinations of columns that fewer than ``k`` rows share."""
    return rows.groupBy(*columns).agg(F.count("*").alias("rows")).filter(F.col("rows") < k)


def two_reviewers(a: DataFrame, b: DataFrame, key: str, rank: str) -> DataFrame:
    """Findings of two reviewers by key: the stronger (lesser) rank and who has it: A, B or Both.

    ``order.with_place`` by rank and key gives the order of the merged review.
    """
    x = a.select(key, F.col(rank).alias("_a"))
    y = b.select(key, F.col(rank).alias("_b"))
    both = x.join(y, key, "full")
    return both.select(key, F.least("_a", "_b").alias(rank), F.when(F.col("_a").isNull(), "B").when(F.col("_b").isNull(), "A").otherwise("Both").alias("source"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, as often as it has them more: ``side`` a or b."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def mapped_or(rows: DataFrame, mapping: DataFrame, on: str, value: str, otherwise: str) -> DataFrame:
    """Rows with what is mapped to them, or the text ``otherwise``."""
    return rows.join(mapping.select(on, value), on, "left").withColumn(value, F.coalesce(value, F.lit(otherwise)))


def grouped_imports(paths: DataFrame, column: str = "path") -> DataFrame:
    """Import paths by what they share: ``prefix`` and its sorted leaves, a glob replacing the names it covers; std first, crate last."""
    p = F.col(column)
    prefix, leaf = F.regexp_extract(p, r"^(.*)::[^:]+$", 1), F.regexp_extract(p, r"([^:]+)$", 1)
    grouped = paths.select(prefix.alias("prefix"), leaf.alias("leaf")).groupBy("prefix").agg(F.collect_set("leaf").alias("_l"))
    by_case = F.array_sort(F.transform("_l", lambda x: F.struct((x != "self").alias("s"), F.lower(x).alias("k"), x.alias("x"))))
    leaves = F.when(F.array_contains("_l", "*"), F.array(F.lit("*"))).otherwise(F.transform(by_case, lambda x: x["x"]))
    rank = F.when(F.col("prefix").rlike(r"^(std|core|alloc)(::|$)"), 0).when(F.col("prefix").rlike(r"^(crate|self|super)(::|$)"), 2).otherwise(1)
    return grouped.select(rank.alias("group_rank"), "prefix", F.array_join(leaves, ", ").alias("leaves"))


def invalid(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """How many rows fail each check (required, enumeration, form, least items), one row for each; null fails."""
    wide = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("failures")) for n in checks])).alias("_x")).select("_x.*")


def finding_checks(id_column: str = "id") -> dict[str, Column]:
    """What a finding's schema asks for: required members, least lengths, the id's form, choices, members of evidence."""
    there = lambda n: F.col(n).isNotNull()
    checks = {"id": F.col(id_column).rlike("^[A-Z0-9-]+-[0-9]{3,}$"), "title": F.length("title") > 0, "severity": F.col("severity").isin(dims.SEVERITIES), "confidence": F.col("confidence").isin(dims.CONFIDENCES)}
    checks |= {n: F.length(n) > 0 for n in ("audit_skill", "surface")} | {n: there(n) for n in ("affected_claims", "evidence")}
    checks["evidence_items"] = F.forall("evidence", lambda e: e["type"].isNotNull() & e["description"].isNotNull())
    checks |= {n: there(n) for n in ("impact", "recommended_fix", "retest_steps", "limitations")}
    return checks | {"some_evidence": F.size("evidence") >= 1}


def unknown_members(rows: DataFrame, document: str, known: list[str]) -> DataFrame:
    """Members of JSON objects that a closed schema doesn't allow: ``member`` and the number of documents with it."""
    names = rows.filter(F.col(document).startswith("{")).select(F.explode(F.array_distinct(F.json_object_keys(document))).alias("member"))
    return names.filter(~F.col("member").isin(known)).groupBy("member").agg(F.count("*").alias("rows"))
