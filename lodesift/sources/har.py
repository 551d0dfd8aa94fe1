"""HAR documents as typed nested columns, whatever types their members have.

A document is parsed once, by a schema of all its levels. Where that finds a member of another type than
the schema's, the document is parsed again level by level, which bears any type.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.operators.nested import complete_json, flatten, flatten_lists, json_list, json_object

PAIR = "name STRING, value STRING, fileName STRING, comment STRING"
BODY = "mimeType STRING, text STRING, size STRING, params STRING"


def _let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``c``, with ``c`` computed once however often ``f`` names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def _pairs(c: Column) -> Column:
    return F.transform(json_list(c), lambda x: json_object(x, PAIR))


def _message(c: Column, body: str) -> Column:
    """A request or response: read with lists as text first, so that no odd member spoils the rest."""

    def parts(raw: Column) -> Column:
        def all_of(inner: Column) -> Column:
            return F.struct(
                raw["method"].alias("method"), raw["url"].alias("url"), raw["status"].alias("status"),
                _pairs(raw["headers"]).alias("headers"), _pairs(raw["cookies"]).alias("cookies"), _pairs(raw["queryString"]).alias("queryString"),
                F.struct(inner["mimeType"].alias("mimeType"), inner["text"].alias("text"), inner["size"].alias("size")).alias(body), _pairs(inner["params"]).alias("params"),
            )

        return F.when(raw.isNotNull(), _let(json_object(raw[body], BODY), all_of))

    return _let(json_object(c, f"method STRING, url STRING, status STRING, headers STRING, cookies STRING, queryString STRING, {body} STRING"), parts)


def _entry(x: Column) -> Column:
    def parts(e: Column) -> Column:
        return F.when(e.isNotNull(), F.struct(*[e[n].alias(n) for n in ("startedDateTime", "time", "pageref", "serverIPAddress")], _message(e["request"], "postData").alias("request"), _message(e["response"], "content").alias("response")))

    return _let(json_object(x, "startedDateTime STRING, time STRING, pageref STRING, request STRING, response STRING, serverIPAddress STRING"), parts)


SCALARS = ("method", "url", "status")
LISTS = ("headers", "cookies", "queryString")
BODY_TEXTS = ("mimeType", "text", "size")
MESSAGES = (("request", "postData"), ("response", "content"))
ABOUT_ENTRY = ("startedDateTime", "time", "pageref", "serverIPAddress")
PAGE = "id: STRING, title: STRING, startedDateTime: STRING, pageTimings: STRUCT<onLoad: STRING, onContentLoad: STRING>"


class _Shape:
    """The schema of a document and the columns made of it; with ``only``, of those members alone."""

    def __init__(self, only: list[str] | None) -> None:
        self.only = only
        self.pair = f"ARRAY<STRUCT<{PAIR.replace(' STRING', ': STRING')}>>"

    def wants(self, name: str) -> bool:
        return self.only is None or name in self.only

    def _message(self, side: str, body: str) -> str:
        members = [f"{n}: STRING" for n in SCALARS if self.wants(f"{side}.{n}")] + [f"{n}: {self.pair}" for n in LISTS if self.wants(f"{side}.{n}")]
        inside = [f"{n}: STRING" for n in BODY_TEXTS if self.wants(f"{side}.{body}")] + ([f"params: {self.pair}"] if self.wants(f"{side}.params") else [])
        return f"{side}: STRUCT<{', '.join([*members, *([f'{body}: STRUCT<' + ', '.join(inside) + '>'] if inside else [])])}>"

    def entry_schema(self) -> str:
        about = [f"{n}: STRING" for n in ABOUT_ENTRY] if self.only is None else []
        return ", ".join([*about, *(self._message(*m) for m in MESSAGES)])

    def schema(self) -> str:
        pages = [f"pages: ARRAY<STRUCT<{PAGE}>>"] if self.wants("pages") else []
        return f"log: STRUCT<{', '.join([*pages, f'entries: ARRAY<STRUCT<{self.entry_schema()}>>'])}>"

    def _shaped(self, m: Column, side: str, body: str) -> Column:
        there = lambda name, kind, c: c if self.wants(f"{side}.{name}") else F.lit(None).cast(kind)
        scalars = [there(n, "string", m[n]).alias(n) for n in SCALARS]
        lists = [there(n, self.pair, m[n]).alias(n) for n in LISTS]
        inside = F.struct(*[there(body, "string", m[body][n]).alias(n) for n in BODY_TEXTS])
        return F.when(m.isNotNull(), F.struct(*scalars, *lists, inside.alias(body), there("params", self.pair, m[body]["params"]).alias("params")))

    def entry(self, e: Column) -> Column:
        plain = [(e[n] if self.only is None else F.lit(None).cast("string")).alias(n) for n in ABOUT_ENTRY]
        return F.when(e.isNotNull(), F.struct(*plain, *[self._shaped(e[side], side, body).alias(side) for side, body in MESSAGES]))

    def document(self, text: Column) -> Column:
        """The value that parse_har gives, by one parse where the document keeps to the schema."""

        def value(read: Column) -> Column:
            log = read["log"]
            pages = log["pages"] if self.wants("pages") else F.lit(None).cast(f"ARRAY<STRUCT<{PAGE}>>")
            plain = F.when(log.isNotNull(), F.struct(pages.alias("pages"), F.transform(log["entries"], self.entry).alias("entries")))
            return F.when(read["odd"].isNotNull(), _by_level(text, self)).otherwise(plain)

        return _let(_read(text, self.schema()), value)

    def odd_entry(self, text: Column) -> Column:
        """An entry of a document that doesn't keep to the schema: most of its entries still do."""
        value = lambda read: F.when(read["odd"].isNotNull(), _entry(text)).otherwise(self.entry(read))
        return F.when(text.startswith("{"), _let(_read(text, self.entry_schema()), value))


def _read(text: Column, schema: str) -> Column:
    """``text`` by a schema; ``odd`` is null where all members are of its types."""
    return F.from_json(text, f"STRUCT<{schema}, odd: STRING>", {"columnNameOfCorruptRecord": "odd", "allowSingleQuotes": "false"})


def parse_har(df: DataFrame, column: str = "har", to: str = "log", only: list[str] | None = None) -> DataFrame:
    """Adds ``to``: the document's ``pages`` and ``entries``, lists read as the docstring of json_list says.

    Lists may be null, missing, a single object, or JSON text; elements of other type than object stay
    as null, so that indexes count all of them. A document that is no complete JSON gives null.

    ``only`` names the members to read, such as ``request.headers``, ``response.content`` or ``pages``;
    any others may be null.
    """
    return df.withColumn(to, _let(complete_json(F.col(column)), _Shape(only).document))


def _by_level(text: Column, shape: _Shape) -> Column:
    """The value that parse_har gives, for a document with members of any type."""
    page = lambda x: json_object(x, "id STRING, title STRING, startedDateTime STRING, pageTimings STRUCT<onLoad: STRING, onContentLoad: STRING>")
    lists = lambda log: F.when(log.isNotNull(), F.struct(F.transform(json_list(log["pages"]), page).alias("pages"), F.transform(json_list(log["entries"]), shape.odd_entry).alias("entries")))
    log = lambda text: _let(json_object(json_object(text, "log STRING")["log"], "version STRING, creator STRING, pages STRING, entries STRING"), lists)
    return log(text)


def har_table(parsed: DataFrame, keys: list[str], name: str, column: str = "log") -> DataFrame:
    """One of the flat tables of parsed HAR documents: pages, entries, or a list of an entry's messages.

    ``name`` is ``pages``, ``entries``, or such as ``request.headers`` and ``response.cookies``, whose
    rows have ``entry_index`` and ``item_index``; pages have ``page_index``.
    """
    if name == "pages":
        return flatten(parsed, keys, column, "pages[]", ["page_index"])
    if name == "entries":
        return flatten(parsed, keys, column, "entries[]", ["entry_index"])
    return flatten(parsed, keys, column, f"entries[].{name}[]", ["entry_index", "item_index"])


def har_lists(parsed: DataFrame, keys: list[str], names: list[str], column: str = "log", carry: dict[str, str] | None = None) -> DataFrame:
    """Several lists of the messages, such as ``request.headers``, in one pass, told apart by ``list``."""
    return flatten_lists(parsed, keys, column, {n: f"entries[].{n}[]" for n in names}, ["entry_index", "item_index"], "list", carry)
