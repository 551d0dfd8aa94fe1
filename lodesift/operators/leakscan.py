"""Search of canary values (sentinels) in captures: candidates, hits, classes, masking, findings."""

from __future__ import annotations

import base64
import gzip
import json
import random
import re
import secrets
import string
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.functions import dims
from lodesift.operators.decode import contained
from lodesift.operators.order import with_place
from lodesift.sources.har import har_lists, har_table

SHORTEST_SENTINEL = 16
AROUND = 80
# Order, surface and list of the fields that are searched.
LISTS = [
    (1, "request", "request_query", "queryString", "queryString"),
    (2, "request", "request_header", "headers", "headers"),
    (3, "request", "request_cookie", "cookies", "cookies"),
    (5, "request", "request_body_param", "params", "postData.params"),
    (6, "response", "response_header", "headers", "headers"),
    (7, "response", "response_cookie", "cookies", "cookies"),
]


# What a finding of a hit says, what stands for a masked header or value, the masked patterns.
TITLE = "Sentinel leaked via %s (%s)"
DESCRIPTION = "%s %s://%s%s entry %d matched %s sentinel after transform %s."
MASKED_HEADER = "<redacted-sensitive-header; sentinel=%s; offset=%d; length=%d>"
TOO_LARGE = "field exceeds max-field-bytes"
SECRET_PAIR = r"""(?i)\b(api[_-]?key|authorization|bearer|secret|password|passphrase|token)\b\s*[:=]\s*['"]?[^'"&\s,}]{8,}"""
LONG_TOKEN = r"\b[A-Za-z0-9._~+/=-]{32,}\b"

#: What every finding of the scan says besides; callers may pass other texts.
ABOUT = {
    "audit_skill": "network-payload-zero-knowledge-test",
    "affected_claims": [],
    "reproduction_steps": ["Seed the same sentinels in a test account.", "Repeat the flow while capturing requests and responses whole.", "Scan the capture and compare location and transform."],
    "impact": "A protected test value could be read in network traffic, against what the product claims about it.",
    "root_cause_hypothesis": "The value is put into a field that the network sees before it is protected end to end.",
    "recommended_fix": "Encrypt on the client before anything is serialized, keep keys there, and send third parties and telemetry no protected values.",
    "retest_steps": ["Make fresh sentinels.", "Repeat the flow with the same capture settings.", "Check that no sentinel shows in raw or decoded fields."],
    "limitations": ["Only the captured flow and reversible encodings are covered."],
}


def sentinel_manifest(run_id: str | None = None, seed: str | None = None, prefix: str = "CANARY") -> list[dict[str, str]]:
    """Six sentinels, one for each category; random, or the same for the same ``seed`` (fixtures only)."""
    draw = random.Random(seed).choice if seed is not None else secrets.choice
    letters = string.ascii_letters + string.digits
    text = lambda n: "".join(draw(letters) for _ in range(n))
    run = run_id or f"run-{text(8).lower()}"
    names = ["body-001", "metadata-001", "key-001", "recovery-001", "credential-001", "control-001"]
    return [{"id": i, "value": f"{prefix}::{run}::{c.upper()}::{text(18)}", "category": c, "use": ""} for i, c in zip(names, dims.SENTINEL_CATEGORIES)]


def load_sentinels(paths: list[str] = (), literals: list[str] = ()) -> list[dict[str, str]]:
    """Sentinels of literals, then of manifests: lists of texts or objects, or objects with ``sentinels``.

    Raises ValueError for another shape, an entry without value, and a value that is blank or shorter
    than 16 characters.
    """
    out = [{"id": f"literal-{k:03d}", "value": v, "category": "plaintext_content", "use": ""} for k, v in enumerate(literals, 1)]
    for path in paths:
        data = json.loads(Path(path).read_text(encoding="utf-8-sig"))
        items = data.get("sentinels", data) if isinstance(data, dict) else data
        if not isinstance(items, list):
            raise ValueError(f"{path}: no list of sentinels")
        for k, item in enumerate(items, 1):
            item = {"value": item} if isinstance(item, str) else item
            if not isinstance(item, dict) or not item.get("value"):
                raise ValueError(f"{path}: entry {k} has no value")
            out.append({"id": str(item.get("id") or f"{Path(path).stem}-{k:03d}"), "value": str(item["value"]), "category": str(item.get("category") or "plaintext_content"), "use": str(item.get("use") or "")})
    for s in out:
        if len(s["value"]) < SHORTEST_SENTINEL or not s["value"].strip():
            raise ValueError(f"{s['id']}: a sentinel needs at least {SHORTEST_SENTINEL} characters")
    return out


def har_candidates(parsed: DataFrame, keys: list[str], column: str = "log") -> DataFrame:
    """Every text field of parsed captures: ``keys``, ``entry_index``, ``ord``, ``item_index``, ``part``, ``direction``, ``surface``, ``location``, ``value``, ``method``, ``url``, ``status``.

    Names of pairs are searched too, as values can leak into them.
    """
    same = [*keys, "entry_index", "ord", "item_index", "part", "direction", "surface", "location", "value", "method", "url", "status"]
    at = F.concat(F.lit("entries["), F.col("entry_index"), F.lit("]."))
    single = [(0, "request", "request_url", "request.url", "request_url"), (4, "request", "request_body", "request.postData.text", "request_postData_text"), (8, "response", "response_body", "response.content.text", "response_content_text")]
    fields = F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(0).alias("item_index"), F.lit(0).alias("part"), F.lit(d).alias("direction"), F.lit(s).alias("surface"), F.concat(at, F.lit(p)).alias("location"), F.col(c).alias("value")) for o, d, s, p, c in single])
    entries = har_table(parsed, keys, "entries", column)
    out = entries.select(*keys, "entry_index", F.col("request_method").alias("method"), F.col("request_url").alias("url"), F.col("response_status").alias("status"), F.explode(fields).alias("_f")).select(*keys, "entry_index", "method", "url", "status", "_f.*").select(*same)
    above = {"method": "entries[].request.method", "url": "entries[].request.url", "status": "entries[].response.status"}
    items = har_lists(parsed, keys, [f"{d}.{n}" for _, d, _, n, _ in LISTS], column, above)
    kinds = F.create_map(*[x for o, d, s, n, shown in LISTS for x in (F.lit(f"{d}.{n}"), F.struct(F.lit(o).alias("ord"), F.lit(d).alias("direction"), F.lit(s).alias("surface"), F.lit(f"{d}.{shown}[").alias("shown")))])
    items = items.withColumn("_k", kinds[F.col("list")])
    masked = F.col("_k.surface").endswith("_header") & F.coalesce(F.lower("name").isin(dims.MASKED_HEADERS), F.lit(False))
    where = F.concat(at, F.col("_k.shown"), F.col("item_index"), F.lit("]."))
    fields = F.array(*[F.struct(F.lit(k).alias("part"), F.concat(where, F.lit(n)).alias("location"), F.col(n).alias("value")) for k, n in enumerate(("name", "value", "fileName"))])
    rows = items.select(*keys, "entry_index", "method", "url", "status", "item_index", "_k.ord", "_k.direction", F.when(masked, F.concat("_k.surface", F.lit("_sensitive"))).otherwise(F.col("_k.surface")).alias("surface"), F.explode(fields).alias("_f"))
    return out.unionByName(rows.select(*keys, "entry_index", "method", "url", "status", "item_index", "ord", "direction", "surface", "_f.*").select(*same)).filter(F.col("value").isNotNull())


def exceeds(c: Column, most_bytes: int) -> Column:
    """Whether a text has more than ``most_bytes`` bytes in UTF-8; never if 0."""
    return F.lit(False) if not most_bytes else F.coalesce(F.octet_length(c) > most_bytes, F.lit(False))


def url_parts(c: Column) -> tuple[Column, Column, Column]:
    """Scheme, host (lower case, no port, no user), path (``/`` if empty), for URLs with blanks in them too."""
    scheme = F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    place = F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    host = F.lower(F.regexp_extract(F.regexp_replace(place, r"^.*@", ""), r"^(\[[^\]]*\]|[^:]*)", 1))
    path = F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return scheme, F.translate(host, "[]", ""), F.when(path == "", "/").otherwise(path)


def telemetry(host: Column, path: Column) -> Column:
    """Whether a whole word of host or path is one of telemetry."""
    return F.arrays_overlap(F.split(F.lower(F.concat_ws(" ", host, path)), "[^a-z0-9]+"), F.array(*[F.lit(w) for w in dims.TELEMETRY_WORDS]))


def classified(df: DataFrame, first_party: list[str] = ()) -> DataFrame:
    """Adds ``classification``, ``severity``, ``classification_tags`` to rows with category, scheme, host, path, surface, direction.

    The first rule that holds decides. Without ``first_party`` no host counts as third party.
    """
    own = F.lit(False)
    for d in first_party:
        own = own | (F.col("host") == d) | F.col("host").endswith(f".{d}")
    third = ~own if first_party else F.lit(False)
    sensitive, control, open_ = F.col("category").isin(dims.SENSITIVE_CATEGORIES), F.col("category") == dims.CONTROL, F.col("scheme") == "http"
    ladder = [
        (control, "expected_control_value", None),
        (open_ & third, "third_party_unencrypted_transport", ["third_party_network_payload", "unencrypted_transport"]),
        (open_ & sensitive, "unencrypted_transport", None),
        (third, "third_party_network_payload", None),
        (F.col("surface").isin(dims.OPEN_SURFACES), "url_or_header_exposure", None),
        (telemetry(F.col("host"), F.col("path")), "telemetry_payload", None),
        (F.col("direction") == "request", "outbound_plaintext_to_service", None),
        (F.col("direction") == "response", "inbound_plaintext_from_service", None),
    ]
    label, tags = F.lit("encoded_plaintext"), F.array(F.lit("encoded_plaintext"))
    for holds, name, more in reversed(ladder):
        label, tags = F.when(holds, name).otherwise(label), F.when(holds, F.array(*[F.lit(t) for t in more or [name]])).otherwise(tags)
    return df.withColumns({"classification": label, "severity": F.when(control, "low").when(sensitive, "high").otherwise("medium"), "classification_tags": tags})


def scrubbed(c: Column) -> Column:
    """Values behind secret names, then long tokens, masked."""
    return F.regexp_replace(F.regexp_replace(c, SECRET_PAIR, "$1=<redacted>"), LONG_TOKEN, "<redacted-token>")


def excerpt(value: Column, sentinel: Column, sentinel_id: Column, pos: Column, surface: Column) -> Column:
    """The text 80 characters around a hit, the sentinel named, secrets masked, line ends escaped."""
    start = F.greatest(pos - AROUND, F.lit(0))
    end = F.least(pos + F.length(sentinel) + AROUND, F.length(value))
    shown = F.replace(value.substr(start + 1, end - start), sentinel, F.concat(F.lit("<SENTINEL:"), sentinel_id, F.lit(">")))
    plain = F.replace(F.replace(scrubbed(shown), F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))
    masked = F.format_string(MASKED_HEADER, sentinel_id, pos, F.length(sentinel))
    return F.when(surface.isin("request_header_sensitive", "response_header_sensitive"), masked).otherwise(plain)


def leak_matches(candidates: DataFrame, keys: list[str], artifact: str, sentinels: list[dict[str, str]], first_party: list[str] = (), depth: int = 3, most_bytes: int = 2_000_000, most_values: int = 20_000) -> DataFrame:
    """Hits of the sentinels in candidates, one row for each place and sentinel.

    Decodings of a place that show the same sentinel merge: the first gives all fields, the transforms
    are listed in order, the longest excerpt stays. Fields over ``most_bytes`` are left to
    ``skipped_fields``. Only hits are shuffled. A negative limit is an error, 0 lifts it (of ``depth``: no
    decoding).
    """
    _checked(depth=depth, most_bytes=most_bytes, most_values=most_values)
    spark = candidates.sparkSession
    table = spark.createDataFrame([(k, s["id"], s["value"], s["category"]) for k, s in enumerate(sentinels)], "needle_ord INT, sentinel_id STRING, sentinel STRING, category STRING")
    about = [*dict.fromkeys([*keys, artifact, "entry_index", "ord", "item_index", "part", "direction", "surface", "location", "method", "url", "status"])]
    hits = contained(candidates.filter(~exceeds(F.col("value"), most_bytes)), about, "value", [s["value"] for s in sentinels], depth, most_bytes, most_values).join(F.broadcast(table), "needle_ord")
    scheme, host, path = url_parts(F.col("url"))
    hits = classified(hits.withColumns({"scheme": scheme, "host": host, "path": path}), first_party)
    hits = hits.withColumns({
        "confidence": F.when(F.col("transform") == "raw", "high").otherwise("medium"),
        "excerpt": excerpt(F.col("decoded"), F.col("sentinel"), F.col("sentinel_id"), F.col("pos"), F.col("surface")),
        "fingerprint": F.left(F.sha2(F.concat_ws(":", artifact, "entry_index", "location", "sentinel_id", "transform"), 256), F.lit(16)),
    })
    place = [*keys, "entry_index", "direction", "surface", "location", "sentinel_id", "category"]
    rest = [c for c in (*about, "needle_ord", "scheme", "host", "path", "classification", "severity", "classification_tags", "confidence", "fingerprint") if c not in place]
    merged = hits.groupBy(*place).agg(
        F.min_by(F.struct(*rest), "decode_ord").alias("_first"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("decode_ord", "transform"))), lambda x: x["transform"])).alias("decode_transforms"),
        F.max_by("excerpt", F.struct(F.length("excerpt"), -F.col("decode_ord"))).alias("excerpt"),
    )
    return merged.select(*place, "_first.*", "decode_transforms", F.array_join("decode_transforms", ", ").alias("decode_transform"), "excerpt")


def _checked(**limits: int) -> None:
    for name, limit in limits.items():
        if limit < 0:
            raise ValueError(f"{name} must not be negative")


def skipped_fields(candidates: DataFrame, most_bytes: int = 2_000_000) -> DataFrame:
    """The fields too large to be searched."""
    _checked(most_bytes=most_bytes)
    return candidates.filter(exceeds(F.col("value"), most_bytes)).withColumn("reason", F.lit(TOO_LARGE))


def without_controls(matches: DataFrame) -> DataFrame:
    return matches.filter(F.col("category") != dims.CONTROL)


def numbered(matches: DataFrame, order: list[str], prefix: str = "LEAK") -> DataFrame:
    """Findings get ``seq``, their number in the order of the capture, and ``id``."""
    return with_place(matches, order, "seq").withColumn("id", F.format_string(f"{prefix}-%03d", "seq"))


def findings(matches: DataFrame, artifact: str, order: list[str], about: dict[str, str | list[str]] = ABOUT, prefix: str = "LEAK") -> DataFrame:
    """Findings of hits, with all members of a finding; ``about`` gives those that are the same for all."""
    rows = numbered(without_controls(matches), order, prefix)
    text = F.format_string(DESCRIPTION, "method", "scheme", "host", "path", "entry_index", "category", "decode_transform")
    evidence = F.array(F.struct(F.lit("har-match").alias("type"), F.col(artifact).alias("file"), "location", text.alias("description"), "excerpt", "sentinel_id", "fingerprint"))
    same = [(F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v)).alias(n) for n, v in about.items()]
    return rows.select("id", F.format_string(TITLE, "surface", "classification").alias("title"), "severity", "confidence", "surface", "classification", "classification_tags", evidence.alias("evidence"), *same)


def scan_summary(parsed: DataFrame, matches: DataFrame, skipped: DataFrame, sentinels: list[dict[str, str]], column: str = "log") -> DataFrame:
    """Counts of a scan in one row."""
    entries = parsed.agg(F.coalesce(F.sum(F.coalesce(F.size(f"{column}.entries"), F.lit(0)).cast("bigint")), F.lit(0)).alias("entries_scanned"))
    hits = matches.agg(F.count("*").alias("matches"), F.count_if(F.col("category") == dims.CONTROL).alias("control_matches"), F.count_if(F.col("category") != dims.CONTROL).alias("findings"))
    left = skipped.agg(F.count("*").alias("skipped_fields"))
    one = lambda d: d.withColumn("_one", F.lit(1))
    return one(entries).join(one(hits), "_one").join(one(left), "_one").drop("_one").withColumn("sentinels_scanned", F.lit(len(sentinels)).cast("bigint"))


def escaped_forms(value: str | None) -> list[tuple[str, str]]:
    """The forms that built-in expressions can't make: JSON-escaped, in a stack trace, packed, in words.

    ``json_ascii`` also escapes what isn't ASCII; ``trace`` is the value as an error message shows it,
    control characters escaped; ``gzip`` is the packed value in base64, as ``decode`` reads it; ``token``
    is each word as a search index keeps it, one row a word.
    """
    if value is None:
        return []
    packed = base64.b64encode(gzip.compress(value.encode("utf-8"), mtime=0)).decode()
    forms = [("json", json.dumps(value, ensure_ascii=False)[1:-1]), ("json_ascii", json.dumps(value)[1:-1]), ("trace", repr(value)[1:-1]), ("gzip", packed)]
    return forms + [("token", w) for w in re.findall(r"\w+", value.lower())]


def sentinel_variants(df: DataFrame, id_column: str, value: str) -> DataFrame:
    """Forms in which a value may leak: as is, lower case, encoded, hashed, cut, escaped, packed, in words.

    Of forms with the same text the first stands, so a value without anything to escape has no ``json`` row.
    """
    v = F.col(value)
    forms = {
        "exact": v, "lower": F.lower(v), "normalized": F.trim(F.regexp_replace(F.lower(v), "[^a-z0-9]+", " ")), "base64": F.base64(F.encode(v, "UTF-8")),
        "base64url": F.translate(F.regexp_replace(F.base64(F.encode(v, "UTF-8")), "=+$", ""), "+/", "-_"), "hex": F.lower(F.hex(F.encode(v, "UTF-8"))),
        "url": F.replace(F.url_encode(v), F.lit("+"), F.lit("%20")), "sha256": F.sha2(v, 256), "truncated": F.left(v, F.lit(SHORTEST_SENTINEL)),
    }
    pairs = F.array(*[F.struct(F.lit(n).alias("variant"), c.alias("text")) for n, c in forms.items()])
    more = F.udf(escaped_forms, "ARRAY<STRUCT<variant: STRING, text: STRING>>", useArrow=False)
    rows = df.select(id_column, F.posexplode(F.concat(pairs, more(v))).alias("_n", "_v")).select(id_column, "_n", "_v.*")
    return rows.groupBy(id_column, "text").agg(F.min_by("variant", "_n").alias("variant")).select(id_column, "variant", "text")
