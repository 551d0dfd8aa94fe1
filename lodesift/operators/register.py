"""Findings register: normalisation, dedupe key, merge of duplicates, status, summary.

A merge is a fold in the order of delivery for the lists and first texts, and a rank comparison for
severity, confidence and status. Both are aggregates here: one shuffle on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.functions import dims
from lodesift.functions.audit_values import utc_text
from lodesift.functions.dims import by_rank, normalized_choice, ranked
from lodesift.operators.order import with_place, with_running_sum
from lodesift.sources.tables import join_small, stored

TEXTS = ["recommended_fix", "impact", "severity_rationale"]
# Other names under which a finding may carry a member.
SYNONYMS = {"finding_id": ["id"], "surface": ["boundary_surface", "crypto_surface", "metadata_surface"], "severity_rationale": ["risk_rationale"], "recommended_fix": ["remediation"], "dedupe_key": ["duplicate_key"]}
# Lists of a finding that not every document has.
OPTIONAL_LISTS = ["fix_commits", "retest_evidence", "status_history"]
ID_FORM = r"^[A-Z0-9-]+-[0-9]{3,}"


def strip(c: Column) -> Column:
    """Without outer white space, no-break spaces included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def distinct_texts(c: Column) -> Column:
    """A list's texts, stripped, without empty ones, the first of equal ones."""
    return F.array_distinct(F.filter(F.transform(c, strip), lambda x: x.isNotNull() & (x != "")))


def dedupe_key(explicit: Column, parts: list[Column]) -> Column:
    """The given key, trimmed and lower-cased; else 16 hex digits of the parts' words."""
    text = F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])
    words = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    given = F.lower(strip(explicit))
    return F.when(F.coalesce(given, F.lit("")) != "", given).otherwise(F.left(F.sha1(words), F.lit(16)))


def has_term(text: Column, terms: list[str]) -> Column:
    """Whether one of the terms stands in the text as a whole word."""
    return text.rlike("(?<![a-z0-9])(" + "|".join(terms) + ")(?![a-z0-9])")


def reviews_to_rerun(source: Column, title: Column, surface: Column, impact: Column, fix: Column) -> Column:
    """Reviews that a finding's words call for, with those it came from, sorted."""
    words = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(surface, F.lit("")), F.coalesce(impact, F.lit(""))))
    head = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(surface, F.lit(""))))
    crypto = has_term(words, dims.CRYPTO_TERMS) | (has_term(F.lower(F.coalesce(fix, F.lit(""))), ["encrypt"]) & has_term(head, dims.CRYPTO_FIX_TERMS))
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    out = F.when(crypto, F.array(*[F.lit(x) for x in dims.CRYPTO_REVIEWS])).otherwise(none)
    for review, terms in dims.RERUN_TERMS.items():
        out = F.concat(out, F.when(has_term(words, terms), F.array(F.lit(review))).otherwise(none))
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(source, none), out)))


def resolved(df: DataFrame) -> DataFrame:
    """Findings with every member under its main name: the first of its names that isn't empty."""
    for name, others in SYNONYMS.items():
        there = [F.when(F.col(c) != "", F.col(c)) for c in (name, *others) if c in df.columns]
        df = df.withColumn(name, F.coalesce(*there) if there else F.lit(None).cast("string"))
    return df


# The steps and the notes of a register.
AGAIN = "Re-run original reproduction: "
DEFAULT_STEP = "Re-run the original reproduction steps against the fixed version and collect evidence."
MERGED = "Merged duplicate source finding(s): %s."
LOWERED = " Confidence lowered from %s to %s because at least one duplicate source has lower confidence."
HIGHER = " Duplicate source reported higher confidence (%s); canonical confidence remains %s until retest evidence justifies raising it."
KEPT = " Status kept %s because at least one duplicate source is not fixed."


def retest_steps(steps: Column, reproduction: Column) -> Column:
    """Retest steps, with a step for each of the reproduction that isn't among them yet; a default one if there are none."""
    again = F.transform(distinct_texts(reproduction), lambda x: F.concat(F.lit(AGAIN), x))
    both = F.array_distinct(F.concat(distinct_texts(steps), again))
    return F.when(F.size(both) > 0, both).otherwise(F.array(F.lit(DEFAULT_STEP)))


EVIDENCE = "ARRAY<STRUCT<type: STRING, description: STRING, file: STRING, location: STRING, excerpt: STRING>>"


def normalized(df: DataFrame, order: list[str]) -> DataFrame:
    """Findings in the register's form, with ``dedupe_key`` and ``ord``, their place in the order of delivery.

    Members may go by their other names; the dedupe key is made of the main ones alone. Unknown choices
    become medium and open; a missing title is ``Untitled finding``; without retest steps the default one
    stands; null lists are empty. ``reproduction_steps``, ``source_ids``, ``source_skills`` and
    ``root_cause_hypothesis`` may be missing, and so may ``affected_skills_to_rerun``, for which the
    reviews that the finding's words call for stand, and the optional lists, whose items are texts or JSON.
    A finding without id has an empty list of ``source_ids`` until ``with_ids`` numbers it. ``order``
    should tell all rows apart.
    """
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    there = lambda n, kind="string": F.col(n) if n in df.columns else F.lit(None).cast(kind)
    texts = lambda n: F.coalesce(there(n, "array<string>"), none)
    optional = [n for n in OPTIONAL_LISTS if n in df.columns]
    explicit = F.coalesce(*[F.when(there(n) != "", there(n)) for n in ("dedupe_key", "duplicate_key")])
    key = dedupe_key(explicit, [there("title"), there("surface"), F.array_join(texts("affected_claims"), " "), there("root_cause_hypothesis"), there("recommended_fix")])
    df = resolved(df.withColumn("_made_key", key))
    one = lambda c: F.when(F.coalesce(strip(c), F.lit("")) != "", F.array(strip(c))).otherwise(none)
    several = lambda lists, single: F.when(F.size(distinct_texts(texts(lists))) > 0, distinct_texts(texts(lists))).otherwise(one(there(single)))
    as_text = lambda n: F.transform(F.col(n), lambda x: x if df.schema[n].dataType.elementType.simpleString() == "string" else F.to_json(x))
    rows = df.select(
        F.struct(*order).alias("ord"),
        F.coalesce("finding_id", F.lit("")).alias("source_id"),
        F.col("_made_key").alias("dedupe_key"),
        F.when(F.coalesce(there("title"), F.lit("")) == "", "Untitled finding").otherwise(there("title")).alias("title"),
        normalized_choice(there("severity"), dims.SEVERITIES, "medium").alias("severity"),
        normalized_choice(there("confidence"), dims.CONFIDENCES, "medium").alias("confidence"),
        normalized_choice(there("status"), dims.STATUSES, "open").alias("status"),
        F.coalesce("surface", F.lit("")).alias("surface"),
        several("source_ids", "finding_id").alias("source_ids"),
        several("source_skills", "audit_skill").alias("source_skills"),
        distinct_texts(texts("affected_claims")).alias("affected_claims"),
        retest_steps(texts("retest_steps"), texts("reproduction_steps")).alias("retest_steps"),
        distinct_texts(texts("limitations")).alias("limitations"),
        F.transform(F.coalesce(there("evidence", EVIDENCE), F.expr(f"CAST(array() AS {EVIDENCE})")), lambda e: F.to_json(e)).alias("evidence"),
        *[F.coalesce(there(t), F.lit("")).alias(t) for t in TEXTS],
        *[F.coalesce(as_text(n), none).alias(n) for n in optional],
        distinct_texts(texts("affected_skills_to_rerun")).alias("rerun"),
    )
    called_for = reviews_to_rerun(F.col("source_skills"), F.col("title"), F.col("surface"), F.col("impact"), F.col("recommended_fix"))
    return rows.withColumn("rerun", F.when(F.size("rerun") > 0, F.col("rerun")).otherwise(called_for))


def sequence(rows: DataFrame) -> DataFrame:
    """``ord``, ``source_id``, ``seq`` of normalized findings: 1 and the number of dedupe keys seen before, in the order of delivery.

    A duplicate doesn't advance it. Only keys, places and ids are shuffled.
    """
    narrow = rows.select("dedupe_key", "ord", "source_id")
    first = stored(narrow.groupBy("dedupe_key").agg(F.min("ord").alias("_first")))
    marked = narrow.join(first, "dedupe_key").select("ord", "source_id", (F.col("ord") == F.col("_first")).cast("bigint").alias("_new"))
    return with_running_sum(marked, ["ord"], F.col("_new"), "seq").select("ord", "source_id", (F.col("seq") + 1 - F.col("_new")).alias("seq"))


def unassigned(seq: Column) -> Column:
    """The id of a finding that came without one."""
    return F.format_string("UNASSIGNED-%03d", seq)


def with_ids(rows: DataFrame, prefix: str = "FINDING", most_broadcast: int = 200_000) -> DataFrame:
    """Normalized findings with ``id`` and whole ``source_ids``.

    A finding without id becomes ``UNASSIGNED`` with its number in the ``sequence``, one whose id has another
    form than the register's gets ``prefix`` and the number, and keeps its own among the source ids. Only
    those numbers are joined to the findings, broadcast up to a counted bound.
    """
    small = stored(sequence(rows).filter(~F.col("source_id").rlike(ID_FORM + "$")).select("ord", "seq"))
    numbered = join_small(rows, small, ["ord"], "left", small.count(), most_broadcast)
    missing = F.col("source_id") == ""
    named = numbered.withColumn("id", accepted_id(F.when(missing, unassigned(F.col("seq"))).otherwise(F.col("source_id")), F.col("seq"), prefix))
    return named.withColumn("source_ids", F.when((F.size("source_ids") == 0) & missing, F.array(unassigned(F.col("seq")))).otherwise(F.col("source_ids"))).drop("seq")


def accepted_id(source: Column, seq: Column, prefix: str = "FINDING") -> Column:
    """A record's id if it has the register's form, else a number of the register."""
    return F.when(source.rlike(ID_FORM + "$"), source).otherwise(F.format_string(f"{prefix}-%03d", seq))


def _lists(rows: DataFrame) -> list[str]:
    return ["source_ids", "source_skills", "affected_claims", "retest_steps", "limitations", "evidence", "rerun", *[n for n in OPTIONAL_LISTS if n in rows.columns]]


def merged_items(rows: DataFrame) -> DataFrame:
    """Items of each dedupe key's lists in long form, equal ones once: ``dedupe_key``, ``kind``, ``item``, ``o``, the first place.

    Made distinct within partitions first, so that a key of a third of all rows moves its distinct items only.
    """
    items = rows.select("dedupe_key", "ord", F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), F.col(n).alias("xs")) for n in _lists(rows)])).alias("_i"))
    items = items.select("dedupe_key", "ord", F.col("_i.kind").alias("kind"), F.posexplode("_i.xs").alias("at", "item")).filter("item <> ''")
    return items.groupBy("dedupe_key", "kind", "item").agg(F.min(F.struct("ord", "at")).alias("o"))


def merged(rows: DataFrame) -> DataFrame:
    """One record for each dedupe key.

    The gravest severity, the least confidence, the status closest to open; the first text that isn't
    empty; lists in order, equal items once, the reviews that any of the findings calls for among them.
    With ``with_ids`` before it, the record has the ``id`` of its first finding. ``merged_items`` has the
    lists in long form, for keys whose lists are too long for a row.
    """
    lists = _lists(rows)
    main = rows.groupBy("dedupe_key").agg(
        F.count("*").alias("records"),
        F.min("ord").alias("first_ord"),
        F.min_by("title", "ord").alias("title"),
        F.min_by("surface", "ord").alias("surface"),
        by_rank(F.min(ranked(F.col("severity"), dims.SEVERITIES)), dims.SEVERITIES).alias("severity"),
        by_rank(F.max(ranked(F.col("confidence"), dims.CONFIDENCES)), dims.CONFIDENCES).alias("confidence"),
        by_rank(F.min(ranked(F.col("status"), dims.STATUS_PRECEDENCE)), dims.STATUS_PRECEDENCE).alias("status"),
        *[F.min_by(t, F.when(F.col(t) != "", F.col("ord"))).alias(t) for t in TEXTS],
        *([F.min_by("id", "ord").alias("id")] if "id" in rows.columns else []),
    )
    joined = merged_items(rows).groupBy("dedupe_key").pivot("kind", lists).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "item"))), lambda x: x["item"]))
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    out = main.join(joined, "dedupe_key", "left").withColumns({n: F.coalesce(F.col(n), none) for n in lists})
    return out.fillna("", TEXTS)


def merge_notes(rows: DataFrame, clock: Column | None = None) -> DataFrame:
    """The note that each duplicate leaves: ``dedupe_key``, ``ord``, ``status``, ``timestamp``, ``note``.

    It tells the duplicate's ids, and what it did to the record's confidence and status. What the record
    was before follows from where each rank came first in the key, a few values that are aggregated in
    partitions, so no task sees a key's rows in a row. ``timestamp`` is that of ``clock``, by default now.
    """
    confidence, state = ranked(F.col("confidence"), dims.CONFIDENCES), ranked(F.col("status"), dims.STATUS_PRECEDENCE)
    firsts = [F.min(F.when(rank == k, F.col("ord"))).alias(f"_{name}{k}") for name, rank, order in (("c", confidence, dims.CONFIDENCES), ("s", state, dims.STATUS_PRECEDENCE)) for k in range(len(order))]
    both = rows.join(stored(rows.groupBy("dedupe_key").agg(F.min("ord").alias("_first"), *firsts)), "dedupe_key").filter(F.col("ord") > F.col("_first"))
    seen = lambda name, n: [F.when(F.col(f"_{name}{k}") < F.col("ord"), k) for k in range(n)]
    before = both.withColumns({"_c": F.greatest(*seen("c", len(dims.CONFIDENCES))), "_s": F.least(*seen("s", len(dims.STATUS_PRECEDENCE)))})
    had, status = by_rank(F.col("_c"), dims.CONFIDENCES), by_rank(F.least(state, F.col("_s")), dims.STATUS_PRECEDENCE)
    on_confidence = F.when(confidence > F.col("_c"), F.format_string(LOWERED, had, "confidence")).when(confidence < F.col("_c"), F.format_string(HIGHER, "confidence", had)).otherwise("")
    on_status = F.when(state < F.col("_s"), F.format_string(KEPT, status)).otherwise("")
    note = F.concat(F.format_string(MERGED, F.array_join("source_ids", ", ")), on_confidence, on_status)
    return before.select("dedupe_key", "ord", status.alias("status"), utc_text(clock).alias("timestamp"), note.alias("note"))


def status_by_severity(rows: DataFrame) -> DataFrame:
    """The summary's table: a row for each status, a column for each severity, zeros, the total."""
    seen = rows.select(normalized_choice(F.col("status"), dims.STATUSES, "open").alias("status"), normalized_choice(F.col("severity"), dims.SEVERITIES, "medium").alias("severity"))
    counts = seen.groupBy("status").pivot("severity", dims.SEVERITIES).count()
    out = dims.dimension(rows.sparkSession, "status", dims.STATUSES).join(counts, "status", "left").fillna(0, dims.SEVERITIES)
    total = F.col(dims.SEVERITIES[0])
    for s in dims.SEVERITIES[1:]:
        total = total + F.col(s)
    return out.select("status", *dims.SEVERITIES, total.alias("total"))


def residual(rows: DataFrame) -> DataFrame:
    """Records not closed and of weight, by their values as they stand."""
    return rows.filter(F.col("status").isin("open", "partially_fixed", "accepted_risk") & F.col("severity").isin("critical", "high", "medium"))


def register_order(rows: DataFrame, id_column: str) -> DataFrame:
    return rows.orderBy(ranked(F.col("severity"), dims.SEVERITIES), id_column)


def in_register_order(rows: DataFrame, order: list[str], severity: str = "severity") -> DataFrame:
    """Records with their ``place`` in the register, from 1: by severity, then ``order``."""
    return with_place(rows.withColumn("_rank", ranked(F.col(severity), dims.SEVERITIES)), ["_rank", *order], "place").drop("_rank")


def referenced(rows: DataFrame, references: DataFrame) -> DataFrame:
    """Which records each ``reference`` names, by id or one of the source ids: matches, and the key if it is only one."""
    names = rows.select("dedupe_key", F.explode(F.array_distinct("source_ids")).alias("reference"))
    hits = references.join(names, "reference", "left")
    return hits.groupBy("reference").agg(F.count("dedupe_key").alias("matches"), F.when(F.count("dedupe_key") == 1, F.min("dedupe_key")).alias("dedupe_key"))


def latest(log: DataFrame, entity: str, value: str, order: list[str]) -> DataFrame:
    """The value of each entity's last row."""
    return log.groupBy(entity).agg(F.max_by(value, F.struct(*order)).alias(value))


def summary_report(rows: DataFrame, id_column: str, most_rows: int | None = None) -> str:
    """The register as Markdown: counts by status and severity, records in order, what is left open.

    Its tables list all records; with ``most_rows`` the first ones, and how many are left out.
    """
    from lodesift.sources.files import left_out, markdown_table

    counts = {r["status"]: r for r in status_by_severity(rows).collect()}  # a row for each status
    head = ["Status", *[s.capitalize() for s in dims.SEVERITIES], "Total"]
    table = markdown_table(head, [[dims.STATUS_LABELS[s], *[counts[s][c] for c in (*dims.SEVERITIES, "total")]] for s in dims.STATUSES])
    columns = [id_column, "severity", "confidence", "status", "title"]

    def listed(these: DataFrame) -> str:
        ordered = register_order(these, id_column).select(*columns)
        shown = ordered.collect() if most_rows is None else ordered.limit(most_rows).collect()
        more = "" if most_rows is None else left_out(these.count() - len(shown))
        return markdown_table(columns, shown) + more if shown or more else ""

    open_ = listed(residual(rows)) or "No critical, high or medium findings are left open."
    return "\n\n".join(["# Summary", "## Counts", table, "## Register", listed(rows) or markdown_table(columns, []), "## Residual risk", open_]) + "\n"


def markdown_cell(c: Column) -> Column:
    return F.replace(F.translate(F.coalesce(c, F.lit("")), "\r\n", "  "), F.lit("|"), F.lit("\\|"))
