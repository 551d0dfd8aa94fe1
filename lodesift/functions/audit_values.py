"""Values of audit records: choices, stand-ins for a missing text, times in several spellings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The register's statuses.
STATUSES = ["open", "fixed", "partially_fixed", "accepted_risk", "not_reproducible"]

# Texts that say nothing about a finding, after folding (see without_value).
STAND_INS = [
    "n a", "na", "n.a", "none", "null", "nil", "nan", "undefined", "tbd", "tba", "tbc", "todo", "to do", "fixme", "xxx", "wip", "pending",
    "unknown", "empty", "blank", "missing", "not available", "not applicable", "not specified", "not provided", "not set", "not given",
    "unspecified", "no text", "no text yet", "nothing", "nothing yet", "no value", "no data", "no description", "no comment", "not yet written", "not written",
    "not yet known", "not known", "not yet", "not yet available", "not yet defined", "not yet specified", "not yet decided", "not yet determined", "not yet completed", "will follow", "follows", "to follow",
    "to be written", "to be completed", "to be done", "to be defined", "to be determined", "to be decided", "to be announced", "to be added", "to be confirmed", "to be filled", "to be filled in", "to be provided", "to be specified", "to come", "coming soon", "placeholder", "see above", "see below", "see title", "same as above", "as above", "ditto", "dummy", "lorem ipsum", "test", "later", "open point", "draft", "in progress", "work in progress", "add later", "fill in", "fill me in", "insert text here", "text here", "description here",
]

BLANKS = " \t\r\n\f\u000b\u00a0\u2007\u2009\u202f\u3000\ufeff"


def stripped(c: Column) -> Column:
    """``c`` without outer blanks (tabs, line ends and no-break spaces too)."""
    return F.btrim(c, F.lit(BLANKS))


def blank_to_null(c: Column) -> Column:
    s = stripped(c)
    return F.when(s != "", s)


def without_value(c: Column) -> Column:
    """True where ``c`` is null, blank, or a stand-in that tells nothing.

    A text is compared whole, without case and with every run of other than letters and digits counting
    as one space, so that a sentence which merely contains such a word has a value.
    """
    # One anchored pattern: on a text that has a value it fails at the first words.
    between = r"[^\p{L}\p{N}]"
    texts = "|".join(re.sub(r"[^a-z0-9]+", f"{between}++".replace("\\", r"\\"), t) for t in dict.fromkeys(STAND_INS))
    return c.isNull() | c.rlike(rf"(?iu)\A{between}*+(?:(?:{texts}){between}*+)?\z")


def choice(c: Column, allowed: list[str]) -> Column:
    """``c`` in the register's form (trimmed, lower case, ``_`` between words), null unless in ``allowed``."""
    folded = F.regexp_replace(F.lower(stripped(c)), r"[\s_\-]+", "_")
    return F.when(folded.isin(allowed), folded)


def status(c: Column) -> Column:
    return choice(c, STATUSES)


def utc_text(clock: Column | None = None) -> Column:
    """A moment as ``2025-01-31T12:34:56Z``, by default now; ``clock`` is a TIMESTAMP that stands in for it."""
    at = F.current_timestamp() if clock is None else clock
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def unix_time(c: Column) -> Column:
    """Seconds since 1970 UTC of a time in any of the spellings below, null where it is none.

    ``2025-01-31T12:34:56`` with ``T`` or blanks, an optional fraction (cut off) and an optional offset
    (``Z``, ``+01:00``, ``-0800``, ``+02``); the same without separators (``20250131T123456Z``); a date
    alone (midnight UTC); a bare number (seconds already). No offset means UTC. Impossible dates and
    clock times give null.
    """
    t = F.upper(stripped(c))
    return _seconds(t, _iso(t))


def with_unix_time(df: DataFrame, column: str, to: str) -> DataFrame:
    """``df`` with ``to``, the unix_time of ``column``, worked out in steps of which each is computed once."""
    steps = df.withColumn("_lodesift_t", F.upper(stripped(F.col(column)))).withColumn("_lodesift_iso", _iso(F.col("_lodesift_t")))
    return steps.withColumn(to, _seconds(F.col("_lodesift_t"), F.col("_lodesift_iso"))).drop("_lodesift_t", "_lodesift_iso")


def _iso(t: Column) -> Column:
    """A time with separators and seconds."""
    minutes = (F.substring(t, 14, 1) == ":") & (F.substring(t, 17, 1) != ":")  # no seconds
    return (
        F.when(F.substring(t, 9, 1) == "T", F.regexp_replace(t, r"^(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)", "$1-$2-$3T$4:$5:$6"))
        .when(minutes, F.concat(F.substring(t, 1, 16), F.lit(":00"), F.substring(t, 17, 99)))
        .otherwise(F.translate(t, ",", "."))
    )


def _seconds(t: Column, iso: Column) -> Column:
    """Seconds of a time ``iso``, or of ``t`` if it is a bare number."""
    behind = F.substring(iso, 11, 99)
    zoned = behind.contains("Z") | behind.contains("+") | behind.contains("-")
    whole = F.when(behind == "", F.concat(iso, F.lit("T00:00:00Z"))).when(zoned, iso).otherwise(F.concat(iso, F.lit("Z")))
    good = iso.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d([.]\d+)?)?(Z|[+-]\d\d(:?\d\d)?)?)?$")
    dated = F.when(good, F.unix_seconds(whole.try_cast("timestamp")))
    bare = F.substring(t, 5, 1).between("0", "9") & (F.substring(t, 9, 1) != "T")
    return F.when(bare | (F.length(t) < 8), F.when(t.rlike(r"^[+-]?\d{1,15}([.]\d*)?$"), F.floor(t.try_cast("decimal(30,6)")).cast("bigint"))).otherwise(dated)
