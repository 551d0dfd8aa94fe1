"""Registered queries of the llm operators, and the same in SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesift.functions.audit_values import STAND_INS, status, stripped, without_value
from lodesift.llm import consensus, forms, mixing, near, packing, reading, secrets
from lodesift.llm.tokens import with_tokens
from lodesift.sources.tables import join_small, stored, table

FIELDS = ["recommended_fix", "impact", "severity_rationale", "status"]


def delivered_last(df: DataFrame, id_column: str, at: str, most_broadcast: int = 200_000) -> DataFrame:
    """Of rows delivered more than once (same id), the last; ties stay."""
    again = stored(df.groupBy(id_column).agg(F.count("*").alias("_n"), F.max(at).alias("_last")).filter("_n > 1").drop("_n"))
    joined = join_small(df, again, [id_column], "left", again.count(), most_broadcast)
    return joined.filter(F.col("_last").isNull() | (F.col(at) == F.col("_last"))).drop("_last")


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Findings with a dedupe key, their fields null where they are without a value, and their trust."""
    rows = table(spark, folder, "findings").select("record_id", "dedupe_key", "audit_skill", "reported_at", "loaded_at", *FIELDS)
    rows = rows.withColumn("key", F.lower(stripped(F.col("dedupe_key")))).filter(F.col("key") != "")
    rows = delivered_last(rows, "record_id", "loaded_at")
    skills = table(spark, folder, "audit_skills").groupBy(F.col("audit_skill")).agg(F.min("trust_rank").alias("trust"))  # fixed: 8 rows
    texts = [F.when(~without_value(F.col(f)), F.col(f)).alias(f) for f in FIELDS[:3]]
    return rows.join(F.broadcast(skills), "audit_skill", "left").select(
        "key", F.col("record_id").alias("id"), "trust", F.unix_micros("reported_at").alias("at"), F.floor(F.lit(1_000_000) / (1 + F.coalesce("trust", F.lit(20)))).alias("weight"), *texts, status(F.col("status")).alias("status")
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """For each dedupe key and field the record whose value survives, by precedence."""
    return consensus.best_values(_candidates(spark, folder), FIELDS, precedence=True).select(F.col("key").alias("dedupe_key"), "field_name", F.col("id").alias("record_id"))


def p1_consensus(spark: SparkSession, folder: str) -> DataFrame:
    """For each dedupe key and field the value closest to the consensus of all, weighted by trust."""
    return consensus.best_values(_candidates(spark, folder), FIELDS).select(F.col("key").alias("dedupe_key"), "field_name", F.col("id").alias("record_id"), "value")


def p1_majority(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of p1_consensus for fields in which one value has over half of the weight: there the vote is known without aligning."""
    rows = stored(_candidates(spark, folder))
    long = rows.select("key", "id", "weight", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in FIELDS])).alias("_f")).select("key", "weight", "_f.*").filter(F.col("value").isNotNull())
    each = long.groupBy("key", "field_name", "value").agg(F.sum("weight").alias("w")).groupBy("key", "field_name").agg(F.max("w").alias("most"), F.sum("w").alias("all"))
    known = each.filter(2 * F.col("most") > F.col("all")).select("key", "field_name")
    return consensus.best_values(rows, FIELDS).join(known, ["key", "field_name"]).select(F.col("key").alias("dedupe_key"), "field_name", F.col("id").alias("record_id"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Where each literal credential of the scan's excerpts starts."""
    found = secrets.find_credentials(table(spark, folder, "scan_hits"), "hit_id", "path", "excerpt")
    return found.select(F.col("id").alias("hit_id"), "start_at")


def p2_masked(spark: SparkSession, folder: str) -> DataFrame:
    """Every excerpt with its credentials masked, and their number."""
    masked = secrets.mask_credentials(table(spark, folder, "scan_hits"), "hit_id", "path", "excerpt")
    return masked.select(F.col("id").alias("hit_id"), "credentials", F.col("masked").alias("excerpt"))


def _impacts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "findings").select("record_id", "title", "impact").filter(~without_value(F.col("impact")))
    return near.classes(rows, "record_id", near.words_of(F.col("title"), F.col("impact")))


P3_THRESHOLD = 0.7


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of findings whose title and impact have a word similarity of at least 0.7."""
    classes, copies = _impacts(spark, folder)
    pairs = near.expand_copies(stored(near.similar_pairs(classes, P3_THRESHOLD)), stored(copies))
    return pairs.select(F.col("a").alias("record_a"), F.col("b").alias("record_b"))


def p3_links(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each finding with a value in impact: its class of equal word sequences, and how many findings it is like."""
    classes, copies = _impacts(spark, folder)
    told = near.links(classes, stored(copies), stored(near.similar_pairs(classes, P3_THRESHOLD)))
    return told.select(F.col("record").alias("record_id"), F.col("class").alias("class_id"), "copies", "links")


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each finding that has a near-duplicate: its group, named by the least record_id, and the group's size."""
    classes, copies = _impacts(spark, folder)
    edges = near.similar_pairs(classes, P3_THRESHOLD).select(F.col("record_a").alias("a"), F.col("record_b").alias("b")).union(copies.select(F.col("first").alias("a"), F.col("record").alias("b")))
    groups = stored(near.components(edges))
    return groups.join(groups.groupBy("group").agg(F.count("*").alias("records")), "group").select(F.col("id").alias("record_id"), F.col("group").alias("group_id"), "records")


P4_MEMBERS = ["title", "surface", "recommended_fix"]


def _forms(spark: SparkSession, folder: str) -> DataFrame:
    return forms.collapse_forms(table(spark, folder, "raw_findings"), "raw_id", ["payload"], forms.json_members(P4_MEMBERS, "findings"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every raw finding but the first of its form, with that first one."""
    return forms.form_copies(_forms(spark, folder)).select(F.col("first").alias("first_raw_id"), F.col("id").alias("raw_id"))


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each distinct raw finding with its number of copies."""
    return forms.form_counts(_forms(spark, folder)).select(F.col("first").alias("raw_id"), "copies")


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The documents' texts in containers of each kind: one row for each text, or part of a long one."""
    filled = packing.packed_texts(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "pack_targets"))
    return filled.withColumnRenamed("id", "doc_id")


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of each kind are."""
    targets = table(spark, folder, "pack_targets")
    return packing.fill_report(packing.packed_texts(table(spark, folder, "documents"), "doc_id", "text", targets), targets)


def p7_check(spark: SparkSession, folder: str) -> DataFrame:
    """Of each kind: the texts that are in containers, containers over the capacity, and texts divided though they fit."""
    targets = table(spark, folder, "pack_targets")
    filled = stored(packing.packed_texts(table(spark, folder, "documents"), "doc_id", "text", targets)).join(F.broadcast(targets), "container_kind")
    full = filled.groupBy("container_kind", "container_id", "capacity_tokens").agg(F.sum("tokens").alias("n")).groupBy("container_kind").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("over_capacity"))
    texts = filled.groupBy("container_kind", "id", "capacity_tokens").agg(F.count("*").alias("parts"), F.sum("tokens").alias("n"))
    texts = texts.groupBy("container_kind").agg(F.count("*").alias("texts"), F.count_if(F.col("parts") != F.ceil(F.col("n") / F.col("capacity_tokens"))).alias("divided"))
    return texts.join(full, "container_kind")


def p8_check(spark: SparkSession, folder: str) -> DataFrame:
    """Of each source with a target: whether it has its share but for one text, or all it may give, and whether any text is repeated too often."""
    mixed, budgets = _mixed(spark, folder)
    told = mixing.shares(mixed, budgets).join(budgets.select("source", "longest"), "source")
    may = F.least("budget", F.col("tokens") * F.col("max_repeats"))
    return told.select("source", "target_share", "max_repeats", (F.abs(F.col("tokens_used") - may) <= F.col("longest")).alias("met"), (F.col("most_copies") > F.col("max_repeats")).alias("too_often"))


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sizes = stored(with_tokens(table(spark, folder, "documents"), ["doc_id", "source"], "text")).withColumnRenamed("doc_id", "id")
    return mixing.mix(sizes, table(spark, folder, "mix_targets"))


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mixture, with how often each is used."""
    return _mixed(spark, folder)[0].select(F.col("id").alias("doc_id"), "source", "tokens", F.col("copies").cast("bigint").alias("copies"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """For each source with a target: its share of the mixture."""
    return mixing.shares(*_mixed(spark, folder))


def _levels(spark: SparkSession, folder: str) -> DataFrame:
    return reading.reading_levels(spark, table(spark, folder, "documents"), table(spark, folder, "reading_labels"))


P9_WORDS = 60


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """The reading level of every document with enough English prose."""
    return _levels(spark, folder).filter((F.col("words") >= P9_WORDS) & F.col("level").isNotNull()).select(F.col("id").alias("doc_id"), F.col("level").alias("reading_level"))


def p9_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its words of English prose, years of school, and the shares of its sentences' levels."""
    return _levels(spark, folder).withColumnRenamed("id", "doc_id")


_STAND_INS = ", ".join(f"'{x}'" for x in STAND_INS)
_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"
_NO_VALUE = "({0} IS NULL OR trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) IN ('', " + _STAND_INS + "))"
_STATUS = f"regexp_replace(lower(trim(status, {_BLANKS})), '[\\s_-]+', '_', 'g')"
_HAS = {f: f"NOT {_NO_VALUE.format(f)}" for f in FIELDS[:3]} | {"status": f"regexp_replace(lower(trim(status, {_BLANKS})), '[\\s_-]+', '_', 'g') IN ('open', 'fixed', 'partially_fixed', 'accepted_risk', 'not_reproducible')"}
P1_FOUND_SQL = f"""
WITH f AS (SELECT *, lower(trim(dedupe_key, {_BLANKS})) AS k FROM findings QUALIFY loaded_at = max(loaded_at) OVER (PARTITION BY record_id)),
g AS (SELECT k FROM f WHERE k <> '' GROUP BY k HAVING count(DISTINCT record_id) >= 2),
r AS (SELECT f.*, coalesce(s.trust_rank, 1000) AS t FROM f JOIN g USING (k) LEFT JOIN audit_skills s ON f.audit_skill = s.audit_skill),
v AS ({" UNION ALL ".join(f"SELECT k, '{f}' AS field_name, t, reported_at, record_id FROM r WHERE {c}" for f, c in _HAS.items())})
SELECT k AS dedupe_key, field_name, record_id FROM v QUALIFY row_number() OVER (PARTITION BY k, field_name ORDER BY t, reported_at DESC NULLS LAST, record_id DESC) = 1
"""
P1_MAJORITY_SQL = P1_FOUND_SQL[: P1_FOUND_SQL.rindex("SELECT k AS")].rstrip().replace("t, reported_at, record_id FROM r", "{} AS value, t, reported_at, record_id FROM r")
for _f in FIELDS:
    P1_MAJORITY_SQL = P1_MAJORITY_SQL.replace(f"'{_f}' AS field_name, {{}} AS value", f"'{_f}' AS field_name, {_f if _f != 'status' else _STATUS} AS value")
P1_MAJORITY_SQL += """,
w AS (SELECT k, field_name, value, sum(floor(1000000 / (1 + CASE WHEN t = 1000 THEN 20 ELSE t END))) AS w FROM v GROUP BY ALL),
m AS (SELECT k, field_name, value FROM w QUALIFY 2 * w > sum(w) OVER (PARTITION BY k, field_name))
SELECT k AS dedupe_key, field_name, record_id FROM v JOIN m USING (k, field_name, value) QUALIFY row_number() OVER (PARTITION BY k, field_name ORDER BY t, reported_at DESC NULLS LAST, record_id DESC) = 1
"""
P3_FOUND_SQL = f"""
WITH f AS (SELECT DISTINCT record_id, regexp_extract_all(translate(concat_ws(' ', title, impact), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS ws FROM findings WHERE NOT {_NO_VALUE.format("impact")}),
w AS (SELECT record_id, unnest(ws) AS w FROM f),
t AS (SELECT record_id, w, count(*) AS n FROM w GROUP BY ALL),
z AS (SELECT record_id, sum(n) AS s FROM t GROUP BY ALL),
c AS (SELECT a.record_id AS record_a, b.record_id AS record_b, sum(least(a.n, b.n)) AS m FROM t a JOIN t b ON a.w = b.w AND a.record_id < b.record_id GROUP BY ALL)
SELECT record_a, record_b FROM c JOIN z x ON x.record_id = record_a JOIN z y ON y.record_id = record_b WHERE m >= 0.7 * (x.s + y.s - m)
"""
_P3_PAIRS = P3_FOUND_SQL.replace("WITH f AS", "WITH RECURSIVE f AS", 1).replace("SELECT record_a, record_b FROM c", ", p AS (SELECT record_a, record_b FROM c", 1) + "),"
P3_GROUPS_SQL = (
    _P3_PAIRS
    + """
e AS (SELECT record_a AS a, record_b AS b FROM p UNION SELECT record_b, record_a FROM p),
r AS (SELECT DISTINCT a AS start, a AS node FROM e UNION SELECT r.start, e.b FROM r JOIN e ON e.a = r.node),
g AS (SELECT node AS record_id, min(start) AS group_id FROM r GROUP BY node)
SELECT record_id, group_id, count(*) OVER (PARTITION BY group_id) AS records FROM g
"""
)
P3_LINKS_SQL = (
    _P3_PAIRS
    + """
k AS (SELECT record_id, array_to_string(ws, ' ') AS words FROM f WHERE len(ws) > 0),
n AS (SELECT a.record_id, count(b.record_id) AS links FROM k a LEFT JOIN (SELECT record_a AS x, record_b AS record_id FROM p UNION SELECT record_b, record_a FROM p) b ON b.x = a.record_id GROUP BY 1)
SELECT k.record_id, min(k.record_id) OVER (PARTITION BY words) AS class_id, count(*) OVER (PARTITION BY words) AS copies, links FROM k JOIN n USING (record_id)
"""
)
_P4 = """
WITH good AS (SELECT raw_id, CAST(payload AS JSON) AS j FROM raw_findings WHERE json_valid(payload)),
one AS (SELECT raw_id, CASE WHEN json_type(j) = 'ARRAY' THEN j -> 0 WHEN json_type(j, '$.findings') = 'ARRAY' THEN j -> '$.findings' -> 0 ELSE j END AS j FROM good),
m AS (SELECT raw_id, lower(unnest(json_keys(j))) AS k, unnest(list_transform(json_keys(j), lambda x: json_extract_string(j, '$."' || x || '"'))) AS v FROM one WHERE json_type(j) = 'OBJECT'),
c AS (SELECT raw_id, regexp_replace(lower(v), '[^\\p{L}\\p{N}]+', '', 'g') AS v, k FROM m WHERE k IN ('title', 'surface', 'recommended_fix')),
r AS (SELECT raw_id, coalesce(max(v) FILTER (k = 'title'), '') AS a, coalesce(max(v) FILTER (k = 'surface'), '') AS b, coalesce(max(v) FILTER (k = 'recommended_fix'), '') AS d FROM c GROUP BY raw_id)
"""
P4_FOUND_SQL = _P4 + "SELECT min(raw_id) OVER (PARTITION BY a, b, d) AS first_raw_id, raw_id FROM r QUALIFY raw_id <> first_raw_id"
P4_COUNTS_SQL = _P4 + "SELECT min(raw_id) AS raw_id, count(*) AS copies FROM r GROUP BY a, b, d"

QUERIES = {"p1_found": p1_found, "p1_consensus": p1_consensus, "p1_majority": p1_majority, "p2_found": p2_found, "p2_masked": p2_masked, "p3_found": p3_found, "p3_links": p3_links, "p3_groups": p3_groups, "p4_found": p4_found, "p4_counts": p4_counts, "p7_containers": p7_containers, "p7_report": p7_report, "p7_check": p7_check, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p8_check": p8_check, "p9_found": p9_found, "p9_levels": p9_levels}
P7_CHECK_SQL = "SELECT container_kind, count(*) AS texts, 0::BIGINT AS divided, 0::BIGINT AS over_capacity FROM pack_targets CROSS JOIN documents WHERE text <> '' GROUP BY 1"
P8_CHECK_SQL = r"""
SELECT regexp_replace(lower(trim(source)), '[\s_\-]+', '_', 'g') AS source, sum(target_share) AS target_share, max(max_repeats) AS max_repeats, true AS met, false AS too_often FROM mix_targets WHERE source IS NOT NULL GROUP BY 1
"""
SQL = {"p7_check": P7_CHECK_SQL, "p8_check": P8_CHECK_SQL, "p1_found": P1_FOUND_SQL, "p1_majority": P1_MAJORITY_SQL, "p3_found": P3_FOUND_SQL, "p3_links": P3_LINKS_SQL, "p3_groups": P3_GROUPS_SQL, "p4_found": P4_FOUND_SQL, "p4_counts": P4_COUNTS_SQL}
