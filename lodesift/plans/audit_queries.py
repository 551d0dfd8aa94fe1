"""Registered queries of the audit operators over the given tables, and the same in SQL."""

from __future__ import annotations

import base64
import gzip
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesift.functions import dims
from lodesift.functions.audit_values import unix_time
from lodesift.operators import coverage, decode, leakscan, patternscan, register
from lodesift.operators.nested import complete_json
from lodesift.plans import core_queries
from lodesift.sources.har import har_lists, har_table, parse_har
from lodesift.sources.tables import table

SENTINELS = [
    {"id": "control", "value": "Strict-Transport-Security", "category": "low_sensitivity_control"},
    {"id": "host", "value": ".scheduler.example", "category": "sensitive_metadata"},
    {"id": "host-test", "value": ".scheduler.test/", "category": "credential"},
    {"id": "word", "value": "oriole", "category": "plaintext_content"},
]
FIRST_PARTY = ["scheduler.example"]


def _captures(spark: SparkSession, folder: str) -> DataFrame:
    return parse_har(table(spark, folder, "har_captures").select("capture_id", "artifact", "har"))


def _products(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    rows = table(spark, folder, "registers").select("register_id", F.lower(F.translate("product", "- ", "  ")).alias("p")).filter(F.length("p") >= 16).orderBy("register_id").collect()  # fixed: 240 rows
    return [(r[0], r[1]) for r in rows]


def leak_scan_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that name a product: the containment join with a small list."""
    products = _products(spark, folder)
    names = spark.createDataFrame([(k, r) for k, (r, _) in enumerate(products)], "needle_ord INT, register_id STRING")
    found = decode.contained(table(spark, folder, "documents"), ["doc_id"], "text", [p for _, p in products])
    return found.join(F.broadcast(names), "needle_ord").select("doc_id", "register_id", F.col("pos").cast("bigint").alias("pos"))


def leak_scan_har(spark: SparkSession, folder: str) -> DataFrame:
    """Sentinels in captures, decoded, classified, merged by place."""
    fields = leakscan.har_candidates(_captures(spark, folder), ["capture_id", "artifact"])
    hits = leakscan.leak_matches(fields, ["capture_id"], "artifact", SENTINELS, FIRST_PARTY)
    return hits.select("capture_id", "entry_index", "direction", "surface", "location", "sentinel_id", "classification", "severity", "confidence", "scheme", "host", "path", "decode_transform", "excerpt", "fingerprint")


def leak_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered findings of the scan."""
    fields = leakscan.har_candidates(_captures(spark, folder), ["capture_id", "artifact"])
    hits = leakscan.leak_matches(fields, ["capture_id"], "artifact", SENTINELS, FIRST_PARTY)
    order = ["capture_id", "entry_index", "ord", "item_index", "part", "needle_ord"]
    lists = [F.array_join(n, "|").alias(n) for n in ("classification_tags", "affected_claims", "reproduction_steps", "retest_steps", "limitations")]
    return leakscan.findings(hits, "artifact", order).select("id", "title", "severity", "confidence", "audit_skill", "surface", "classification", F.to_json("evidence").alias("evidence"), "impact", "root_cause_hypothesis", "recommended_fix", *lists)


def scan_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of the scan."""
    parsed = _captures(spark, folder)
    fields = leakscan.har_candidates(parsed, ["capture_id", "artifact"])
    hits = leakscan.leak_matches(fields, ["capture_id"], "artifact", SENTINELS, FIRST_PARTY)
    return leakscan.scan_summary(parsed, hits, leakscan.skipped_fields(fields), SENTINELS)


def har_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Cookies, query strings and body parameters of the captures."""
    parsed = _captures(spark, folder)
    rows = har_lists(parsed, ["capture_id"], ["request.cookies", "request.queryString", "request.params", "response.cookies"])
    return rows.select("capture_id", "entry_index", "list", "item_index", "name", "value")


def classify_ladder(spark: SparkSession, folder: str) -> DataFrame:
    """Every entry's URL classed as if a sentinel of some category were in it."""
    entries = har_table(_captures(spark, folder), ["capture_id"], "entries").select("capture_id", "entry_index", F.coalesce("request_url", F.lit("")).alias("url"))
    scheme, host, path = leakscan.url_parts(F.col("url"))
    categories = F.array(*[F.lit(c) for c in dims.SENTINEL_CATEGORIES])
    rows = entries.withColumns({"scheme": scheme, "host": host, "path": path, "category": F.get(categories, F.pmod(F.col("entry_index"), F.lit(6))), "surface": F.lit("request_body"), "direction": F.when(F.col("entry_index") % 2 == 0, "request").otherwise("response")})
    return leakscan.classified(rows, ["scheduler.example", "example"]).select("capture_id", "entry_index", "scheme", "host", "path", "category", "classification", "severity", F.array_join("classification_tags", ",").alias("tags"))


def sentinel_variants(spark: SparkSession, folder: str) -> DataFrame:
    """The forms of the products' names that SQL can make as well: all but the packed one."""
    return sentinel_variants_all(spark, folder).filter("variant <> 'gzip'")


def sentinel_variants_all(spark: SparkSession, folder: str) -> DataFrame:
    """Every form in which the products' names may leak."""
    return leakscan.sentinel_variants(table(spark, folder, "registers").filter(F.length("product") >= 16), "register_id", "product")


def leak_scan_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Encoded product names that the decoder reads again."""
    rows = table(spark, folder, "registers").filter(F.length("product") >= 16)
    variants = leakscan.sentinel_variants(rows, "register_id", "product").filter(F.col("variant").isin("base64", "hex", "base64url"))
    texts = decode.decoded_values(variants, ["register_id", "variant"], "text", depth=1)
    return texts.join(rows.select("register_id", F.col("product").alias("decoded")), ["register_id", "decoded"]).select("register_id", "variant").distinct()


def leak_scan_encoded(spark: SparkSession, folder: str) -> DataFrame:
    """Product names planted in every encoding and in chains of them, and the chain by which the scan reads each."""
    p = F.concat("product", F.lit(" & more"))
    b64 = lambda c: F.base64(F.encode(c, "UTF-8"))
    bare = lambda c: F.translate(b64(c), "+/=", "-_")
    member = lambda c: F.concat(F.lit('{"a/b": [1, {"c~d": "'), F.replace(c, F.lit("&"), F.lit("\\u0026")), F.lit('"}]}'))
    packed = F.udf(lambda v: base64.b64encode(gzip.compress(v.encode(), mtime=0)).decode(), "STRING", useArrow=True)
    squeezed = F.udf(lambda v: base64.b64encode(zlib.compress(v.encode())).decode(), "STRING", useArrow=True)
    form, percent = F.url_encode(p), F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))
    planted = {
        "raw": p, "percent": percent, "form": form, "entity": F.replace(p, F.lit("&"), F.lit("&amp;")), "member": member(p), "field": F.concat(F.lit("x=1&y="), form, F.lit("&y=2")),
        "base64": b64(p), "jwt": F.concat(F.lit("e30."), bare(p), F.lit(".sig")), "hex": F.lower(F.hex(F.encode(p, "UTF-8"))),
        "run": F.concat(F.lit("see <"), b64(p), F.lit("> there")), "hex run": F.concat(F.lit("id "), F.hex(F.encode(p, "UTF-8")), F.lit(";")), "gzip": packed(p), "zlib": squeezed(p),
        "base64 of member": b64(member(p)), "form of member": F.url_encode(member(p)), "four deep": b64(b64(b64(b64(p)))),
    }
    rows = table(spark, folder, "registers").filter(F.length("product") >= 16)
    rows = rows.select("register_id", p.alias("product"), F.explode(F.array(*[F.struct(F.lit(n).alias("planted"), c.alias("value")) for n, c in planted.items()])).alias("_p")).select("register_id", "product", "_p.*")
    sought = [r[0] for r in rows.select("product").distinct().collect()]  # fixed: at most 240 names
    names = spark.createDataFrame([(k, v) for k, v in enumerate(sought)], "needle_ord INT, product STRING")
    hits = decode.contained(rows, ["register_id", "planted", "product"], "value", sought, depth=3).join(F.broadcast(names), ["needle_ord", "product"])
    return hits.groupBy("register_id", "planted").agg(F.min_by("transform", "decode_ord").alias("transform"))


def _scan_lines(spark: SparkSession, folder: str) -> DataFrame:
    return patternscan.lines(table(spark, folder, "scan_hits"), ["hit_id", "path"], "excerpt")


def pattern_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the excerpts by the patterns they match."""
    hits = patternscan.pattern_hits(_scan_lines(spark, folder), "text", dims.PATTERNS)
    return hits.select("hit_id", F.col("line").cast("bigint").alias("line"), "category", "severity_hint", patternscan.is_test_path(F.col("path")).alias("test_path"), patternscan.masked_line(F.col("text")).alias("excerpt"))


def pattern_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Hits by category."""
    return patternscan.counts_by(patternscan.pattern_hits(_scan_lines(spark, folder), "text", dims.PATTERNS), "category")


def rust_section_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Lines by section of the boundary scan."""
    return patternscan.counts_by(patternscan.boundary_scan(table(spark, folder, "scan_hits"), "path", "excerpt"), "section")


def source_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of the scan by kind."""
    p = F.col("path")
    return table(spark, folder, "scan_hits").select("hit_id", patternscan.is_source_path(p).alias("source"), patternscan.is_test_path(p).alias("test"), patternscan.in_left_out_folder(p, ["deploy"]).alias("left_out"))


def byte_limit_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Documents over a size in bytes."""
    return table(spark, folder, "documents").filter(leakscan.exceeds(F.col("text"), 2_000)).select("doc_id", F.octet_length("text").cast("bigint").alias("bytes"))


def search_packs(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the excerpts by the search packs they match."""
    return patternscan.counts_by(patternscan.pack_hits(_scan_lines(spark, folder), "text"), "pack")


def static_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The static scan over the excerpts as files: folder and suffix rules, hits in the report's order."""
    sources = table(spark, folder, "scan_hits").select(F.concat_ws("/", F.col("hit_id").cast("string"), "path").alias("path"), "excerpt")
    hits = patternscan.in_report_order(patternscan.static_scan(sources, "path", "excerpt", leave_out=["deploy"]))
    return hits.select("place", "category", "path", F.col("line").cast("bigint").alias("line"), "severity_hint", "test_path", "note", "excerpt")


def static_scan_capped(spark: SparkSession, folder: str) -> DataFrame:
    """The scan's report with its cap of 5,000 hits, taken in the order of paths and lines; the cap is the feature."""
    sources = table(spark, folder, "scan_hits").select(F.concat_ws("/", F.col("hit_id").cast("string"), "path").alias("path"), "excerpt")
    return patternscan.capped(patternscan.static_scan(sources, "path", "excerpt"), 5_000).select("category", "path", F.col("line").cast("bigint").alias("line"))


def _register(spark: SparkSession, folder: str) -> DataFrame:
    """Findings in the register's form, each bringing its own status as an entry of the history."""
    entry = F.array(F.struct(F.date_format("reported_at", "yyyy-MM-dd").alias("timestamp"), F.coalesce("status", F.lit("")).alias("status")))
    rows = table(spark, folder, "findings").withColumn("status_history", entry)
    return register.with_ids(register.normalized(rows, ["loaded_at", "record_id"]))


def dedupe_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Findings' dedupe keys, given or made of their words."""
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    key = register.dedupe_key(F.col("dedupe_key"), [F.col("title"), F.col("surface"), F.array_join(F.coalesce("affected_claims", none), " "), F.lit(""), F.col("recommended_fix")])
    return table(spark, folder, "findings").select("record_id", "loaded_at", key.alias("made_key")).select("record_id", "made_key")


def register_merge(spark: SparkSession, folder: str) -> DataFrame:
    """One record for each dedupe key, with all its lists."""
    out = register.merged(_register(spark, folder))
    shown = lambda n, *members: F.array_join(F.transform(n, lambda x: F.concat_ws("/", *[F.get_json_object(x, f"$.{m}") for m in members])), "|").alias(n)
    lists = [F.array_join(n, "|").alias(n) for n in ("source_ids", "source_skills", "affected_claims", "retest_steps", "limitations", "rerun")]
    return out.select("dedupe_key", "id", "records", "title", "surface", "severity", "confidence", "status", *register.TEXTS, *lists, shown("evidence", "type", "file", "location"), shown("status_history", "timestamp", "status"))


def register_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Each finding's id in the register and the number it would fall back to."""
    rows = register.normalized(table(spark, folder, "findings"), ["loaded_at", "record_id"])
    named = F.when(F.col("source_id") == "", register.unassigned(F.col("seq"))).otherwise(F.col("source_id"))
    return register.sequence(rows).select("ord.record_id", F.unix_micros("ord.loaded_at").alias("loaded_us"), "source_id", "seq", register.accepted_id(named, F.col("seq")).alias("id"))


def register_notes(spark: SparkSession, folder: str) -> DataFrame:
    """What each duplicate changed in its record; the clock stands still."""
    notes = register.merge_notes(_register(spark, folder), F.lit("2025-01-31 12:34:56").cast("timestamp"))
    return notes.select("dedupe_key", "ord.record_id", F.unix_micros("ord.loaded_at").alias("loaded_us"), "status", "timestamp", "note")


def register_places(spark: SparkSession, folder: str) -> DataFrame:
    """The register in its order: by severity, then id."""
    placed = register.in_register_order(register.merged(_register(spark, folder)), ["id", "dedupe_key"])
    return placed.select("place", "severity", "id", "dedupe_key")


def rerun_inference(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews that each finding calls for."""
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    return table(spark, folder, "findings").select("record_id", F.array_join(register.reviews_to_rerun(none, F.col("title"), F.col("surface"), F.col("impact"), F.col("recommended_fix")), ",").alias("rerun"))


def status_severity_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """Findings by status and severity."""
    out = register.status_by_severity(table(spark, folder, "findings"))
    return out.select("status", *[F.col(c).cast("bigint").alias(c) for c in (*dims.SEVERITIES, "total")])


def residual_risk(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of weight that aren't closed."""
    return register.residual(table(spark, folder, "findings")).groupBy("status", "severity").agg(F.count("*").alias("findings"))


def current_status(spark: SparkSession, folder: str) -> DataFrame:
    """The last status of each finding in the order of receipt."""
    log = table(spark, folder, "status_history").select(F.upper(F.trim("finding_id")).alias("finding_id"), "status", "received_at", "update_id").filter(F.col("status").isNotNull())
    return register.latest(log, "finding_id", "status", ["received_at", "update_id", "status"])


def choice_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """Choices of findings and orders in their form."""
    rows = table(spark, folder, "findings").select(F.lit("severity").alias("kind"), F.col("severity").alias("given"), dims.normalized_choice(F.col("severity"), dims.SEVERITIES, "medium").alias("form"))
    other = table(spark, folder, "findings").select(F.lit("status"), "status", dims.normalized_choice(F.col("status"), dims.STATUSES, "open"))
    third = table(spark, folder, "orders").select(F.lit("priority"), "o_orderpriority", dims.normalized_choice(F.regexp_replace("o_orderpriority", "^[0-9]-", ""), dims.SEVERITIES, "medium"))
    return rows.union(other).union(third).groupBy("kind", "given", "form").agg(F.count("*").alias("rows"))


def reference_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """What the finding ids of the status log name in the register: none, one or several records."""
    ids = table(spark, folder, "status_history").select(F.col("finding_id").alias("reference")).filter(F.col("finding_id").isNotNull()).distinct()
    return register.referenced(register.merged(_register(spark, folder)), ids).select("reference", "matches")


def field_class_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Scan hits by category, empty categories included."""
    classes = spark.createDataFrame([(p[0],) for p in dims.PATTERNS] + [("unknown",)], "category STRING")
    return coverage.class_counts(table(spark, folder, "scan_hits"), "category", classes)


def claim_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Findings by retest limitation they list."""
    return coverage.exploded_counts(table(spark, folder, "findings"), "limitations")


def multi_surface_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Dedupe keys reported on several surfaces."""
    return coverage.on_several(table(spark, folder, "findings").filter(F.col("dedupe_key").isNotNull()), "dedupe_key", "surface")


def high_cardinality_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Different values of the events' columns."""
    return coverage.distinct_counts(table(spark, folder, "events"), ["user_id", "event_type", "value", "props"])


def high_cardinality_approx(spark: SparkSession, folder: str) -> DataFrame:
    """About how many different values the events' columns have."""
    return coverage.distinct_counts(table(spark, folder, "events"), ["user_id", "event_type", "value", "props"], approximate=True)


def small_anonymity_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Combinations of language and source that few documents share."""
    return coverage.small_groups(table(spark, folder, "documents"), ["lang", "source"], 5)


def fan_in_out(spark: SparkSession, folder: str) -> DataFrame:
    """How many surfaces a review reports on, and how many reviews report on a surface."""
    return coverage.fan(table(spark, folder, "findings").filter(F.col("audit_skill").isNotNull() & F.col("surface").isNotNull()), "audit_skill", "surface")


def reviewer_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Two raters' documents: the lesser rating, and whose it is."""
    rows = table(spark, folder, "reading_labels").filter(F.col("years_of_school").isNotNull())
    by = lambda r: rows.filter(F.col("rater") == r).groupBy("doc_id").agg(F.min("years_of_school").alias("years"))
    return coverage.two_reviewers(by("rater_01"), by("rater_02"), "doc_id", "years")


def claim_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Documents no rater has rated."""
    return coverage.without_match(table(spark, folder, "documents").select("doc_id"), table(spark, folder, "reading_labels"), ["doc_id"])


def orphan_refs(spark: SparkSession, folder: str) -> DataFrame:
    """Finding ids of the status log that no finding defines."""
    log = table(spark, folder, "status_history").select("update_id", F.array("finding_id").alias("ids")).filter(F.col("finding_id").isNotNull())
    return coverage.orphans(log, "update_id", "ids", table(spark, folder, "findings"), "finding_id")


def differential_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Titles and severities that differ between two reviews, as often as they do."""
    rows = table(spark, folder, "findings")
    side = lambda s: rows.filter(F.col("audit_skill") == s).select("severity", "surface")
    return coverage.differences(side("crypto-architecture-review"), side("metadata-leakage-inventory"))


def boundary_flows(spark: SparkSession, folder: str) -> DataFrame:
    """Supply across nations of different regions with returned goods, as flows across zones."""
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("element"), F.col("n_regionkey").alias("zone"))
    s, c = table(spark, folder, "supplier"), table(spark, folder, "customer")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    flows = lines.join(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    flows = flows.select(F.col("s_nationkey").alias("source"), F.col("c_nationkey").alias("destination"), F.col("l_returnflag").alias("encryption_state"))
    return coverage.crossing(flows, nations, ["R"]).groupBy("source_zone", "destination_zone").agg(F.count("*").alias("flows"))


def _transitions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "findings").filter(F.col("severity").isNotNull() & F.col("status").isNotNull())
    return rows.select(F.col("severity").alias("source"), F.col("status").alias("destination")).union(rows.filter(F.col("confidence").isNotNull()).select("status", "confidence")).distinct()


def reachability(spark: SparkSession, folder: str) -> DataFrame:
    """What is reachable from each severity in the graph of values that occur together."""
    edges = _transitions(spark, folder)
    starts = table(spark, folder, "findings").select(F.col("severity").alias("start")).filter("start IS NOT NULL").distinct()
    return coverage.reachable(edges, starts)


def schema_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Findings that fail the checks a finding's schema makes: required members, least lengths, forms, choices, items."""
    return coverage.invalid(table(spark, folder, "findings"), coverage.finding_checks("finding_id"))


def schema_members(spark: SparkSession, folder: str) -> DataFrame:
    """Findings as received with members that a closed schema doesn't know, and how often each such member occurs."""
    rows = table(spark, folder, "raw_findings").select("raw_id", complete_json(F.col("payload")).alias("document"))
    return coverage.unknown_members(rows, "document", dims.FINDING_MEMBERS)


def time_spellings(spark: SparkSession, folder: str) -> DataFrame:
    """Readable and unreadable times of the status log."""
    return table(spark, folder, "status_history").agg(F.count_if(unix_time(F.col("history_timestamp")).isNull()).alias("unreadable"), F.count("*").alias("rows"))


def unmapped_units(spark: SparkSession, folder: str) -> DataFrame:
    """Registers with a document of their repository, or the text that there is none."""
    docs = table(spark, folder, "documents").groupBy("repository").agg(F.min("doc_id").cast("string").alias("first_doc"))
    return coverage.mapped_or(table(spark, folder, "registers").select("register_id", "repository"), docs, "repository", "first_doc", "none found")


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(values: list[str]) -> str:
    return "(" + ", ".join(map(_q, values)) + ")"


_LINES = r"""
raw AS (SELECT hit_id, path, regexp_split_to_array(excerpt, '\r\n|\r|\n') AS ls FROM scan_hits WHERE length(excerpt) > 0),
cut AS (SELECT hit_id, path, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls FROM raw),
lines AS (SELECT hit_id, path, unnest(ls) AS t, generate_subscripts(ls, 1) AS line FROM cut)
"""
_CHOICE = "CASE WHEN {f} IN {a} THEN {f} ELSE {d} END"


def _choice(column: str, allowed: list[str], default: str) -> str:
    folded = f"translate(lower(trim({column})), '- ', '__')"
    known = "CASE " + " ".join(f"WHEN {folded} = {_q(k)} THEN {_q(v)}" for k, v in dims.ALIASES.items()) + f" ELSE {folded} END"
    return f"CASE WHEN ({known}) IN {_in(allowed)} THEN ({known}) ELSE {_q(default)} END"


def _rank(expression: str, order: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {expression} = {_q(x)} THEN {k}" for k, x in enumerate(order)) + " END"


def _at(expression: str, order: list[str]) -> str:
    return "[" + ", ".join(map(_q, order)) + f"][({expression}) + 1]"


_TEST = "(" + " OR ".join(f"list_contains(string_split(lower(path), '/'), {_q(x)})" for x in dims.TEST_FOLDERS) + " OR " + " OR ".join(f"lower(path) LIKE {_q('%' + x.replace('_', chr(92) + '_'))} ESCAPE '\\'" for x in dims.TEST_ENDINGS) + ")"
_MASK = "regexp_replace(regexp_replace(regexp_replace(t, '\"[A-Za-z0-9+/=_-]{12,}\"', '\"<redacted-long-literal>\"', 'g'), '''[A-Za-z0-9+/=_-]{12,}''', '''<redacted-long-literal>''', 'g'), '(?i)(key|secret|password|token|passphrase)\\s*[:=]\\s*(\"[^''\"]+\"|''[^''\"]+'')', '\\1=<redacted>', 'g')"
_HITS = f"WITH {_LINES}, hits AS (" + " UNION ALL ".join(f"SELECT *, {_q(c)} AS category, {_q(s)} AS severity_hint FROM lines WHERE regexp_matches(t, {_q(rx)})" for c, s, rx, _ in dims.PATTERNS) + ")"
_HAR = r"""
WITH docs AS (SELECT capture_id, trim(har, chr(65279) || ' ' || chr(10) || chr(13) || chr(9)) AS h FROM har_captures),
good AS (SELECT capture_id, CAST(h AS JSON) AS h FROM docs WHERE json_valid(h)),
lists AS (SELECT capture_id, CASE json_type(h, '$.log.entries') WHEN 'ARRAY' THEN json_extract(h, '$.log.entries[*]') WHEN 'OBJECT' THEN [json_extract(h, '$.log.entries')] END AS es FROM good),
every AS (SELECT capture_id, unnest(es) AS e, CAST(generate_subscripts(es, 1) - 1 AS INTEGER) AS entry_index FROM lists),
entries AS (SELECT * FROM every WHERE json_type(e) = 'OBJECT')
"""
_KEY = "CASE WHEN trim(coalesce(dedupe_key, '')) <> '' THEN lower(trim(dedupe_key)) ELSE left(sha1(trim(regexp_replace(lower(concat_ws(' ', coalesce(title, ''), coalesce(surface, ''), coalesce(array_to_string(affected_claims, ' '), ''), '', coalesce(recommended_fix, ''))), '[^a-z0-9]+', ' ', 'g'))), 16) END"
_TERM = "regexp_matches({t}, '(^|[^a-z0-9])({p})($|[^a-z0-9])')"


def _term(text: str, terms: list[str]) -> str:
    return _TERM.format(t=text, p="|".join(terms))


_WORDS = "lower(concat_ws(' ', coalesce(title, ''), coalesce(surface, ''), coalesce(impact, '')))"
_HEAD = "lower(concat_ws(' ', coalesce(title, ''), coalesce(surface, '')))"
_CRYPTO = f"({_term(_WORDS, dims.CRYPTO_TERMS)} OR ({_term('lower(coalesce(recommended_fix, ' + chr(39) * 2 + '))', ['encrypt'])} AND {_term(_HEAD, dims.CRYPTO_FIX_TERMS)}))"
_RERUN = " || ".join([f"(CASE WHEN {_CRYPTO} THEN [{', '.join(map(_q, dims.CRYPTO_REVIEWS))}] ELSE [] END)"] + [f"(CASE WHEN {_term(_WORDS, t)} THEN [{_q(r)}] ELSE [] END)" for r, t in dims.RERUN_TERMS.items()])
def _union(kind: str, items: str) -> str:
    """Two tables: a key's items of a list by their first place, and the items in one text."""
    return f"""x_{kind} AS (SELECT k, item, min(o * 1000 + pos) AS p FROM (SELECT k, o, unnest({items}) AS item, generate_subscripts({items}, 1) AS pos FROM n) WHERE item <> '' GROUP BY ALL),
{kind} AS (SELECT k, string_agg(item, '|' ORDER BY p) AS {kind} FROM x_{kind} GROUP BY k)"""


def _trimmed(column: str) -> str:
    return f"list_transform(coalesce({column}, []), lambda x: trim(x))"


_SKILL = "CASE WHEN trim(coalesce(audit_skill, '')) <> '' THEN [trim(audit_skill)] ELSE [] END"
_STEPS = f"CASE WHEN len(list_filter({_trimmed('retest_steps')}, lambda x: x <> '')) > 0 THEN {_trimmed('retest_steps')} ELSE [{_q(register.DEFAULT_STEP)}] END"
_NUMBERED = f"""
WITH a AS (SELECT *, {_KEY} AS k, {_choice("severity", dims.SEVERITIES, "medium")} AS sev, {_choice("confidence", dims.CONFIDENCES, "medium")} AS con, {_choice("status", dims.STATUSES, "open")} AS sta, row_number() OVER (ORDER BY loaded_at, record_id) AS o FROM findings),
b AS (SELECT *, CASE WHEN o = min(o) OVER (PARTITION BY k) THEN 1 ELSE 0 END AS new FROM a),
d AS (SELECT *, 1 + coalesce(sum(new) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seq FROM b),
s AS (SELECT *, CASE WHEN coalesce(finding_id, '') <> '' THEN finding_id ELSE printf('UNASSIGNED-%03d', CAST(seq AS INTEGER)) END AS sid FROM d),
n AS (SELECT *, CASE WHEN regexp_matches(sid, '^[A-Z0-9-]+-[0-9]{{3,}}$') THEN sid ELSE printf('FINDING-%03d', CAST(seq AS INTEGER)) END AS id,
{_rank("sev", dims.SEVERITIES)} AS sr, {_rank("con", dims.CONFIDENCES)} AS cr, {_rank("sta", dims.STATUS_PRECEDENCE)} AS tr FROM s)
"""
_REGISTER = f"""{_NUMBERED},
m AS (SELECT k, count(*) AS records, arg_min(CASE WHEN coalesce(title, '') = '' THEN 'Untitled finding' ELSE title END, o) AS title, arg_min(coalesce(surface, ''), o) AS surface, arg_min(id, o) AS id, min(sr) AS s, max(cr) AS c, min(tr) AS t,
{", ".join(f"coalesce(arg_min({x}, o) FILTER ({x} <> ''), '') AS {x}" for x in register.TEXTS)} FROM n GROUP BY k),
{_union("source_ids", "[trim(sid)]")}, {_union("source_skills", _SKILL)}, {_union("affected_claims", _trimmed("affected_claims"))}, {_union("retest_steps", _STEPS)}, {_union("limitations", _trimmed("limitations"))},
{_union("rerun", f"list_sort(list_distinct({_SKILL} || {_RERUN}))")}, {_union("status_history", "[strftime(reported_at, '%Y-%m-%d') || '/' || coalesce(status, '')]")},
e AS (SELECT k, CAST(x AS VARCHAR) AS item, any_value(concat_ws('/', x.type, x.file, x.location)) AS shown, min(o * 1000 + pos) AS p FROM (SELECT k, o, unnest(evidence) AS x, generate_subscripts(evidence, 1) AS pos FROM n) GROUP BY ALL),
evidence AS (SELECT k, string_agg(shown, '|' ORDER BY p) AS evidence FROM e GROUP BY k)
"""
_LISTS = ["source_ids", "source_skills", "affected_claims", "retest_steps", "limitations", "rerun", "evidence", "status_history"]
_NOTES = f"""{_NUMBERED},
r AS (SELECT *, max(cr) OVER w AS hc, min(tr) OVER w AS ht FROM n WINDOW w AS (PARTITION BY k ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT k AS dedupe_key, record_id, epoch_us(loaded_at) AS loaded_us, {_at("least(tr, ht)", dims.STATUS_PRECEDENCE)} AS status, '2025-01-31T12:34:56Z' AS timestamp,
'Merged duplicate source finding(s): ' || trim(sid) || '.' || CASE WHEN cr > hc THEN ' Confidence lowered from ' || {_at("hc", dims.CONFIDENCES)} || ' to ' || con || ' because at least one duplicate source has lower confidence.'
WHEN cr < hc THEN ' Duplicate source reported higher confidence (' || con || '); canonical confidence remains ' || {_at("hc", dims.CONFIDENCES)} || ' until retest evidence justifies raising it.' ELSE '' END
|| CASE WHEN tr < ht THEN ' Status kept ' || sta || ' because at least one duplicate source is not fixed.' ELSE '' END AS note
FROM r WHERE hc IS NOT NULL
"""
_HOST = r"lower(regexp_extract(regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1), '^.*@', ''), '^([^:]*)', 1))"
_PATH = r"regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
_SENSITIVE = f"category IN {_in(dims.SENSITIVE_CATEGORIES)}"
_THIRD = "NOT (host = 'scheduler.example' OR host LIKE '%.scheduler.example' OR host = 'example' OR host LIKE '%.example')"
_TELE = f"list_has_any(regexp_split_to_array(lower(host || ' ' || path), '[^a-z0-9]+'), [{', '.join(map(_q, dims.TELEMETRY_WORDS))}])"

_SCRUB = f"regexp_replace(regexp_replace(shown, '(?i)\\b(api[_-]?key|authorization|bearer|secret|password|passphrase|token)\\b\\s*[:=]\\s*[''\"]?[^''\"&\\s,}}]{{8,}}', '\\1=<redacted>', 'g'), '\\b[A-Za-z0-9._~+/=-]{{32,}}\\b', '<redacted-token>', 'g')"
_PLACE = "capture_id, entry_index, direction, surface, location, sentinel_id, category"
# The scan in SQL: plain texts and members of JSON bodies, the only encodings in the test tables; leak_scan_encoded plants the others.
_LEAK = (
    _HAR
    + """, single AS (SELECT capture_id, entry_index, e, e ->> '$.request.method' AS method, e ->> '$.request.url' AS url, e ->> '$.response.status' AS status FROM entries),
lists_ AS ("""
    + " UNION ALL ".join(f"SELECT capture_id, entry_index, method, url, {o} AS ord, '{d}' AS direction, '{s}' AS surface, '{d}.{shown}[' AS shown, json_extract(e, '$.{d}.{'postData.params' if n == 'params' else n}') AS xs FROM single" for o, d, s, n, shown in leakscan.LISTS)
    + """), texts AS (SELECT * REPLACE (CASE WHEN json_type(xs) = 'VARCHAR' AND json_valid(xs ->> '$') THEN CAST(xs ->> '$' AS JSON) ELSE xs END AS xs) FROM lists_),
arrays AS (SELECT * REPLACE (CASE json_type(xs) WHEN 'ARRAY' THEN json_extract(xs, '$[*]') WHEN 'OBJECT' THEN [xs] END AS xs) FROM texts),
items AS (SELECT * EXCLUDE (xs), unnest(xs) AS x, CAST(generate_subscripts(xs, 1) - 1 AS INTEGER) AS item_index FROM arrays),
fields AS ("""
    + " UNION ALL ".join(f"SELECT capture_id, entry_index, method, url, {o} AS ord, 0 AS item_index, 0 AS part, '{d}' AS direction, '{s}' AS surface, 'entries[' || entry_index || '].{p}' AS location, e ->> '$.{p}' AS value FROM single" for o, d, s, p in ((0, "request", "request_url", "request.url"), (4, "request", "request_body", "request.postData.text"), (8, "response", "response_body", "response.content.text")))
    + " UNION ALL "
    + " UNION ALL ".join(
        f"SELECT capture_id, entry_index, method, url, ord, item_index, {k}, direction, surface || CASE WHEN surface LIKE '%_header' AND lower(x ->> '$.name') IN {_in(dims.MASKED_HEADERS)} THEN '_sensitive' ELSE '' END, 'entries[' || entry_index || '].' || shown || item_index || '].{n}', x ->> '$.{n}' FROM items WHERE json_type(x) = 'OBJECT'"
        for k, n in enumerate(("name", "value", "fileName"))
    )
    + f"""), sentinels AS (SELECT * FROM (VALUES {", ".join(f"({k}, {_q(s['id'])}, {_q(s['value'])}, {_q(s['category'])})" for k, s in enumerate(SENTINELS))}) AS v(needle_ord, sentinel_id, sentinel, category)),
documents_ AS (SELECT * FROM fields WHERE regexp_matches(value, '^\\s*["{{\\[]') AND json_valid(value)),
members AS (SELECT d.* EXCLUDE (value), 'raw -> json:' || replace(replace(t.fullkey, '."', '.'), '.', '/') AS transform, t.id + 1 AS decode_ord, t.atom ->> '$' AS decoded FROM documents_ d, json_tree(d.value) t WHERE t.type = 'VARCHAR'),
once AS (SELECT * FROM members QUALIFY row_number() OVER (PARTITION BY capture_id, location, decoded ORDER BY decode_ord) = 1),
decoded_ AS (SELECT * EXCLUDE (value), 'raw' AS transform, 0 AS decode_ord, value AS decoded FROM fields WHERE value IS NOT NULL UNION ALL SELECT * FROM once),
hits AS (SELECT d.*, s.*, strpos(decoded, sentinel) - 1 AS pos, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) AS scheme, {_HOST} AS host, CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END AS path FROM decoded_ d JOIN sentinels s ON contains(d.decoded, s.sentinel)),
third AS (SELECT *, NOT (host = 'scheduler.example' OR host LIKE '%.scheduler.example') AS third FROM hits),
classed AS (SELECT *, CASE WHEN category = 'low_sensitivity_control' THEN 'expected_control_value' WHEN scheme = 'http' AND third THEN 'third_party_unencrypted_transport' WHEN scheme = 'http' AND {_SENSITIVE} THEN 'unencrypted_transport' WHEN third THEN 'third_party_network_payload'
WHEN surface IN {_in(dims.OPEN_SURFACES)} THEN 'url_or_header_exposure' WHEN {_TELE} THEN 'telemetry_payload' WHEN direction = 'request' THEN 'outbound_plaintext_to_service' ELSE 'inbound_plaintext_from_service' END AS classification,
CASE WHEN category = 'low_sensitivity_control' THEN 'low' WHEN {_SENSITIVE} THEN 'high' ELSE 'medium' END AS severity, CASE WHEN transform = 'raw' THEN 'high' ELSE 'medium' END AS confidence,
replace(substr(decoded, greatest(pos - 80, 0) + 1, least(pos + length(sentinel) + 80, length(decoded)) - greatest(pos - 80, 0)), sentinel, '<SENTINEL:' || sentinel_id || '>') AS shown FROM third),
matches AS (SELECT c.*, a.artifact, left(sha256(concat_ws(':', a.artifact, entry_index, location, sentinel_id, transform)), 16) AS fingerprint,
CASE WHEN surface IN ('request_header_sensitive', 'response_header_sensitive') THEN '<redacted-sensitive-header; sentinel=' || sentinel_id || '; offset=' || pos || '; length=' || length(sentinel) || '>' ELSE replace(replace({_SCRUB}, chr(13), '\\r'), chr(10), '\\n') END AS excerpt
FROM classed c JOIN har_captures a USING (capture_id)),
chains AS (SELECT {_PLACE}, string_agg(transform, ', ' ORDER BY decode_ord) AS decode_transform, arg_max(excerpt, (length(excerpt), -decode_ord)) AS excerpt FROM matches GROUP BY ALL),
merged AS (SELECT f.* EXCLUDE (excerpt), c.decode_transform, c.excerpt FROM (SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY {_PLACE} ORDER BY decode_ord) = 1) f JOIN chains c USING ({_PLACE}))
"""
)
_TITLES = "printf('Sentinel leaked via %s (%s)', surface, classification)"
_SAME = ", ".join(f"{_q('|'.join(v) if isinstance(v, list) else v)} AS {n}" for n, v in leakscan.ABOUT.items())
_TEXT = "concat(coalesce(method, 'null'), ' ', coalesce(scheme, 'null'), '://', coalesce(host, 'null'), coalesce(path, 'null'), ' entry ', entry_index, ' matched ', category, ' sentinel after transform ', decode_transform, '.')"
_PACKS = ", ".join(f"CASE WHEN regexp_matches(t, {_q(rx)}) THEN {_q(name)} END" for name, rx in dims.SEARCH_PACKS)
_SUFFIX = "(" + "|".join(x.replace(".", "[.]") for x in dims.SOURCE_SUFFIXES) + ")$"
_FOLDER = f"list_has_any(string_split(path, '/')[:-2], [{', '.join(map(_q, dims.LEFT_OUT_FOLDERS))}]) OR regexp_matches(path, '(^|/)[.]cache[^/]*/')"
_DEPLOY = "list_contains(string_split(path, '/')[:-2], 'deploy')"
_FILES = _HITS.replace("WITH ", "WITH scan_hits_ AS (SELECT * REPLACE (concat_ws('/', hit_id, path) AS path) FROM scan_hits), ", 1).replace("FROM scan_hits WHERE", f"FROM scan_hits_ WHERE regexp_matches(path, {_q('[^/]' + _SUFFIX)}) AND NOT ({_FOLDER}) AND")
_ORD = _rank("category", [p[0] for p in dims.PATTERNS])
_CUT = f"CASE WHEN length({_MASK}) > 500 THEN left({_MASK}, 497) || '...' ELSE {_MASK} END"
_PLANTED = {
    "raw": "raw", "percent": "raw -> url-percent", "form": "raw -> form-url-encoded", "entity": "raw -> html-entity", "member": "raw -> json:$/a~1b[1]/c~0d", "field": "raw -> form-url-encoded", "base64": "raw -> base64", "jwt": "raw -> jwt-segment:1", "hex": "raw -> hex",
    "run": "raw -> token-base64", "hex run": "raw -> token-hex", "gzip": "raw -> base64", "zlib": "raw -> base64", "base64 of member": "raw -> base64 -> json:$/a~1b[1]/c~0d", "form of member": "raw -> form-url-encoded -> json:$/a~1b[1]/c~0d",
}

_CHECKS = {
    "id": "regexp_matches(finding_id, '^[A-Z0-9-]+-[0-9]{3,}$')", "title": "length(title) > 0", "severity": f"severity IN {_in(dims.SEVERITIES)}", "confidence": f"confidence IN {_in(dims.CONFIDENCES)}", "audit_skill": "length(audit_skill) > 0", "surface": "length(surface) > 0",
    "affected_claims": "affected_claims IS NOT NULL", "evidence": "evidence IS NOT NULL", "evidence_items": "len(list_filter(evidence, lambda x: x.type IS NULL OR x.description IS NULL)) = 0", "impact": "impact IS NOT NULL", "recommended_fix": "recommended_fix IS NOT NULL",
    "retest_steps": "retest_steps IS NOT NULL", "limitations": "limitations IS NOT NULL", "some_evidence": "len(evidence) >= 1",
}

SQL = {
    "leak_scan_raw": "WITH p AS (SELECT register_id, lower(translate(product, '- ', '  ')) AS p FROM registers WHERE length(product) >= 16) SELECT doc_id, register_id, strpos(text, p) - 1 AS pos FROM documents JOIN p ON contains(text, p)",
    "har_pairs": _HAR
    + ", sides AS ("
    + " UNION ALL ".join(f"SELECT capture_id, entry_index, '{d}.{n}' AS list, json_extract(e, '$.{d}.{p}') AS xs FROM entries" for d, n, p in (("request", "cookies", "cookies"), ("request", "queryString", "queryString"), ("request", "params", "postData.params"), ("response", "cookies", "cookies")))
    + "), items AS (SELECT capture_id, entry_index, list, CASE json_type(xs) WHEN 'ARRAY' THEN json_extract(xs, '$[*]') WHEN 'OBJECT' THEN [xs] END AS xs FROM sides), flat AS (SELECT capture_id, entry_index, list, unnest(xs) AS x, CAST(generate_subscripts(xs, 1) - 1 AS INTEGER) AS item_index FROM items) SELECT capture_id, entry_index, list, item_index, x ->> '$.name' AS name, x ->> '$.value' AS value FROM flat WHERE json_type(x) = 'OBJECT'",
    "classify_ladder": _HAR
    + rf""", u AS (SELECT capture_id, entry_index, coalesce(e ->> '$.request.url', '') AS url FROM entries),
p AS (SELECT capture_id, entry_index, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS scheme, {_HOST} AS host, CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END AS path, [{", ".join(map(_q, dims.SENTINEL_CATEGORIES))}][entry_index % 6 + 1] AS category FROM u),
c AS (SELECT *, CASE WHEN category = 'low_sensitivity_control' THEN 'expected_control_value' WHEN scheme = 'http' AND {_THIRD} THEN 'third_party_unencrypted_transport' WHEN scheme = 'http' AND {_SENSITIVE} THEN 'unencrypted_transport' WHEN {_THIRD} THEN 'third_party_network_payload' WHEN {_TELE} THEN 'telemetry_payload' WHEN entry_index % 2 = 0 THEN 'outbound_plaintext_to_service' ELSE 'inbound_plaintext_from_service' END AS classification FROM p)
SELECT *, CASE WHEN category = 'low_sensitivity_control' THEN 'low' WHEN {_SENSITIVE} THEN 'high' ELSE 'medium' END AS severity, CASE classification WHEN 'third_party_unencrypted_transport' THEN 'third_party_network_payload,unencrypted_transport' ELSE classification END AS tags FROM c""",
    "sentinel_variants": """
WITH v AS (SELECT register_id, unnest(['exact', 'lower', 'normalized', 'base64', 'base64url', 'hex', 'url', 'sha256', 'truncated', 'json', 'json_ascii', 'trace']) AS variant, generate_subscripts(range(12), 1) AS n,
unnest([product, lower(product), trim(regexp_replace(lower(product), '[^a-z0-9]+', ' ', 'g')), base64(encode(product)), rtrim(translate(base64(encode(product)), '+/', '-_'), '='), lower(hex(encode(product))), url_encode(product), sha256(product), left(product, 16), product, product, product]) AS text FROM registers WHERE length(product) >= 16
UNION ALL SELECT register_id, 'token', 13, unnest(regexp_extract_all(lower(product), '\\w+')) FROM registers WHERE length(product) >= 16)
SELECT register_id, variant, text FROM v QUALIFY row_number() OVER (PARTITION BY register_id, text ORDER BY n) = 1
""",
    "leak_scan_decoded": "SELECT register_id, unnest(['base64', 'hex'] || CASE WHEN regexp_matches(base64(encode(product)), '[+/=]') THEN ['base64url'] ELSE [] END) AS variant FROM registers WHERE length(product) >= 16",
    "leak_scan_encoded": f"SELECT register_id, planted, transform FROM registers CROSS JOIN (VALUES {', '.join(f'({_q(n)}, {_q(t)})' for n, t in _PLANTED.items())}) AS v(planted, transform) WHERE length(product) >= 16",
    "leak_scan_har": _LEAK + "SELECT capture_id, entry_index, direction, surface, location, sentinel_id, classification, severity, confidence, scheme, host, path, decode_transform, excerpt, fingerprint FROM merged",
    "leak_findings": _LEAK
    + f"""SELECT printf('LEAK-%03d', row_number() OVER (ORDER BY capture_id, entry_index, ord, item_index, part, needle_ord)) AS id, {_TITLES} AS title, severity, confidence, surface, classification,
CASE classification WHEN 'third_party_unencrypted_transport' THEN 'third_party_network_payload|unencrypted_transport' ELSE classification END AS classification_tags,
CAST(json_array(json_object('type', 'har-match', 'file', artifact, 'location', location, 'description', {_TEXT}, 'excerpt', excerpt, 'sentinel_id', sentinel_id, 'fingerprint', fingerprint)) AS VARCHAR) AS evidence, {_SAME} FROM merged WHERE category <> 'low_sensitivity_control'""",
    "scan_summary": _LEAK + f"SELECT (SELECT CAST(coalesce(sum(len(es)), 0) AS BIGINT) FROM lists) AS entries_scanned, count(*) AS matches, count(*) FILTER (category = 'low_sensitivity_control') AS control_matches, count(*) FILTER (category <> 'low_sensitivity_control') AS findings, (SELECT count(*) FROM fields WHERE octet_length(encode(value)) > 2000000) AS skipped_fields, CAST({len(SENTINELS)} AS BIGINT) AS sentinels_scanned FROM merged",
    "pattern_scan": f"{_HITS} SELECT hit_id, line, category, severity_hint, {_TEST} AS test_path, CASE WHEN length({_MASK}) > 500 THEN left({_MASK}, 497) || '...' ELSE {_MASK} END AS excerpt FROM hits",
    "pattern_counts": f"{_HITS} SELECT category, count(*) AS hits FROM hits GROUP BY category",
    "search_packs": f"WITH {_LINES} SELECT pack, count(*) AS hits FROM (SELECT unnest([{_PACKS}]) AS pack FROM lines) WHERE pack IS NOT NULL GROUP BY pack",
    "static_scan": f"{_FILES}, o AS (SELECT *, {_ORD} AS pattern_ord FROM hits) SELECT row_number() OVER (ORDER BY category, path, line, pattern_ord) AS place, category, path, line, severity_hint, {_TEST} AS test_path, {_at('pattern_ord', [p[3] for p in dims.PATTERNS])} AS note, trim({_CUT}, ' ' || chr(9)) AS excerpt FROM o WHERE NOT {_DEPLOY}",
    "static_scan_capped": f"{_FILES} SELECT category, path, line FROM hits ORDER BY path, line, {_ORD} LIMIT 5000",
    "rust_section_counts": f"WITH {_LINES}, kept AS (SELECT * FROM lines WHERE NOT regexp_matches(path, '^(target|vendor|third_party)/|(^|/)\\.git/')) SELECT section, count(*) AS hits FROM ("
    + " UNION ALL ".join(f"SELECT {_q(n)} AS section FROM kept WHERE regexp_matches(path, {_q(dims.RUST_SECTION_FILES.get(n, chr(92) + '.rs$'))}) AND regexp_matches(t, {_q(rx)})" for n, rx in dims.RUST_SECTIONS)
    + ") GROUP BY section",
    "source_paths": f"SELECT hit_id, regexp_matches(path, {_q('[^/]' + _SUFFIX)}) AS source, {_TEST} AS test, list_has_any(string_split(path, '/')[:-2], [{', '.join(map(_q, [*dims.LEFT_OUT_FOLDERS, 'deploy']))}]) OR regexp_matches(path, '(^|/)[.]cache[^/]*/') AS left_out FROM scan_hits",
    "byte_limit_filter": "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents WHERE octet_length(encode(text)) > 2000",
    "dedupe_keys": f"SELECT record_id, {_KEY} AS made_key FROM findings",
    "register_merge": _REGISTER
    + f"SELECT m.k AS dedupe_key, id, records, title, surface, {_at('s', dims.SEVERITIES)} AS severity, {_at('c', dims.CONFIDENCES)} AS confidence, {_at('t', dims.STATUS_PRECEDENCE)} AS status, recommended_fix, impact, severity_rationale, {', '.join(f'coalesce({n}, {chr(39) * 2}) AS {n}' for n in _LISTS)} FROM m "
    + " ".join(f"LEFT JOIN {n} ON {n}.k = m.k" for n in _LISTS),
    "register_ids": _NUMBERED + "SELECT record_id, epoch_us(loaded_at) AS loaded_us, coalesce(finding_id, '') AS source_id, CAST(seq AS BIGINT) AS seq, id FROM n",
    "register_notes": _NOTES,
    "register_places": _REGISTER + f"SELECT row_number() OVER (ORDER BY s, id, k) AS place, {_at('s', dims.SEVERITIES)} AS severity, id, k AS dedupe_key FROM m",
    "rerun_inference": f"SELECT record_id, array_to_string(list_sort(list_distinct({_RERUN})), ',') AS rerun FROM findings",
    "status_severity_pivot": f"WITH n AS (SELECT {_choice('severity', dims.SEVERITIES, 'medium')} AS sev, {_choice('status', dims.STATUSES, 'open')} AS status FROM findings), s AS (SELECT unnest([{', '.join(map(_q, dims.STATUSES))}]) AS status) SELECT s.status, {', '.join(f'count(*) FILTER (sev = {_q(x)}) AS {x}' for x in dims.SEVERITIES)}, count(sev) AS total FROM s LEFT JOIN n ON n.status = s.status GROUP BY s.status",
    "residual_risk": "SELECT status, severity, count(*) AS findings FROM findings WHERE status IN ('open', 'partially_fixed', 'accepted_risk') AND severity IN ('critical', 'high', 'medium') GROUP BY ALL",
    "current_status": "SELECT upper(trim(finding_id, ' ')) AS finding_id, arg_max(status, (received_at, update_id, status)) AS status FROM status_history WHERE status IS NOT NULL GROUP BY 1",
    "choice_normalize": f"SELECT kind, given, form, count(*) AS rows FROM (SELECT 'severity' AS kind, severity AS given, {_choice('severity', dims.SEVERITIES, 'medium')} AS form FROM findings UNION ALL SELECT 'status', status, {_choice('status', dims.STATUSES, 'open')} FROM findings UNION ALL SELECT 'priority', o_orderpriority, {_choice('regexp_replace(o_orderpriority, ' + _q('^[0-9]-') + ', ' + chr(39) * 2 + ')', dims.SEVERITIES, 'medium')} FROM orders) GROUP BY ALL",
    "reference_lookup": f"WITH n AS (SELECT {_KEY} AS k, finding_id FROM findings WHERE finding_id <> ''), r AS (SELECT DISTINCT finding_id AS reference FROM status_history WHERE finding_id IS NOT NULL) SELECT reference, count(DISTINCT k) AS matches FROM r LEFT JOIN n ON n.finding_id = r.reference GROUP BY reference",
    "field_class_counts": f"SELECT c.category, count(s.hit_id) AS rows FROM (SELECT unnest([{', '.join([*[_q(p[0]) for p in dims.PATTERNS], _q('unknown')])}]) AS category) c LEFT JOIN scan_hits s ON s.category = c.category GROUP BY 1",
    "claim_counts": "SELECT limitations, count(*) AS rows FROM (SELECT unnest(list_distinct(limitations)) AS limitations FROM findings) GROUP BY 1",
    "multi_surface_fields": "SELECT dedupe_key, count(DISTINCT surface) AS surfaces FROM findings WHERE dedupe_key IS NOT NULL GROUP BY 1 HAVING count(DISTINCT surface) >= 2",
    "high_cardinality_fields": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"values\" FROM events" for c in ("user_id", "event_type", "value", "props")),
    "small_anonymity_sets": "SELECT lang, source, count(*) AS rows FROM documents GROUP BY ALL HAVING count(*) < 5",
    "fan_in_out": "WITH e AS (SELECT audit_skill AS a, surface AS b FROM findings WHERE audit_skill IS NOT NULL AND surface IS NOT NULL), o AS (SELECT a AS node, count(DISTINCT b) AS fan_out FROM e GROUP BY 1), i AS (SELECT b AS node, count(DISTINCT a) AS fan_in FROM e GROUP BY 1) SELECT coalesce(o.node, i.node) AS node, coalesce(fan_out, 0) AS fan_out, coalesce(fan_in, 0) AS fan_in FROM o FULL JOIN i ON o.node = i.node",
    "reviewer_merge": "WITH r AS (SELECT doc_id, rater, min(years_of_school) AS y FROM reading_labels WHERE years_of_school IS NOT NULL GROUP BY ALL), a AS (SELECT * FROM r WHERE rater = 'rater_01'), b AS (SELECT * FROM r WHERE rater = 'rater_02') SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, least(a.y, b.y) AS years, CASE WHEN a.y IS NULL THEN 'B' WHEN b.y IS NULL THEN 'A' ELSE 'Both' END AS source FROM a FULL JOIN b ON a.doc_id = b.doc_id",
    "claim_coverage": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM reading_labels r WHERE r.doc_id = d.doc_id)",
    "orphan_refs": "SELECT update_id, finding_id AS reference FROM status_history s WHERE finding_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM findings f WHERE f.finding_id = s.finding_id)",
    "differential_fields": "WITH a AS (SELECT severity, surface FROM findings WHERE audit_skill = 'crypto-architecture-review'), b AS (SELECT severity, surface FROM findings WHERE audit_skill = 'metadata-leakage-inventory') SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'b' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)",
    "boundary_flows": "SELECT a.n_regionkey AS source_zone, b.n_regionkey AS destination_zone, count(*) AS flows FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey WHERE l_returnflag = 'R' AND a.n_regionkey <> b.n_regionkey GROUP BY ALL",
    "reachability": "WITH RECURSIVE r AS (SELECT * FROM findings WHERE severity IS NOT NULL AND status IS NOT NULL), e AS (SELECT severity AS source, status AS destination FROM r UNION SELECT status, confidence FROM r WHERE confidence IS NOT NULL), w AS (SELECT DISTINCT severity AS start, severity AS node FROM findings WHERE severity IS NOT NULL UNION SELECT w.start, e.destination FROM w JOIN e ON e.source = w.node) SELECT start, node FROM w",
    "schema_checks": "WITH c AS (SELECT "
    + ", ".join(f"count(*) FILTER (NOT coalesce({c}, false)) AS {n}" for n, c in _CHECKS.items())
    + f" FROM findings) SELECT unnest([{', '.join(map(_q, _CHECKS))}]) AS \"check\", unnest([{', '.join(_CHECKS)}]) AS failures FROM c",
    "schema_members": f"WITH d AS (SELECT CAST(payload AS JSON) AS j FROM raw_findings WHERE json_valid(payload)), m AS (SELECT unnest(json_keys(j)) AS member FROM d WHERE json_type(j) = 'OBJECT') SELECT member, count(*) AS rows FROM m WHERE member NOT IN {_in(dims.FINDING_MEMBERS)} GROUP BY 1",
    "time_spellings": core_queries.TIMES_SQL + "SELECT count(*) FILTER (ts IS NULL) AS unreadable, count(*) AS rows FROM u",
    "unmapped_units": "SELECT r.repository, register_id, coalesce(first_doc, 'none found') AS first_doc FROM registers r LEFT JOIN (SELECT repository, CAST(min(doc_id) AS VARCHAR) AS first_doc FROM documents GROUP BY 1) d ON d.repository = r.repository",
}

QUERIES = {f.__name__: f for f in (
    leak_scan_raw, leak_scan_har, leak_findings, scan_summary, har_pairs, classify_ladder, sentinel_variants, sentinel_variants_all, leak_scan_decoded, leak_scan_encoded, pattern_scan, search_packs, static_scan, static_scan_capped, pattern_counts, rust_section_counts, source_paths,
    byte_limit_filter, dedupe_keys, register_merge, register_ids, register_notes, register_places, rerun_inference, status_severity_pivot, residual_risk, current_status, choice_normalize, reference_lookup, field_class_counts, claim_counts,
    multi_surface_fields, high_cardinality_fields, high_cardinality_approx, small_anonymity_sets, fan_in_out, reviewer_merge, claim_coverage, orphan_refs, differential_fields, boundary_flows, reachability, schema_checks, schema_members, time_spellings, unmapped_units,
)}
