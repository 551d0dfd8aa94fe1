"""Flat tables out of deeply nested records, with parent-child links.

Text is parsed once on the JVM into typed columns that bear members of unexpected type; a batch of
such records then goes to Python as Arrow buffers, where every child table is made from list offsets
alone: the rows of a list's elements are its child array, the parent of each is found from the offsets
by vectorised repetition, and keys reach the children by ``take``. No row is looked at by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BOM = "﻿"


def complete_json(c: Column) -> Column:
    """``c`` without a byte order mark where it is one complete JSON document, else null.

    A parser stops where the value ends; to be complete nothing may follow it. That is checked by
    counting the elements of the array that the text gives between brackets.
    """
    text = F.btrim(c, F.lit(" \t\r\n" + BOM))
    return F.when((text != "") & (F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1), text)


def json_object(c: Column, schema: str) -> Column:
    """The object ``c`` holds, null where it is anything else; a member of unexpected type is null."""
    return F.when(c.startswith("{"), F.from_json(c, schema, {"allowSingleQuotes": "false"}))


def json_list(c: Column) -> Column:
    """The elements of the list ``c`` holds, as JSON text; a single object counts as a list of one."""
    return F.when(c.startswith("["), F.from_json(c, "ARRAY<STRING>")).when(c.startswith("{"), F.array(c))


def _list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of a list column: for each element its row and its place in the list, and the elements."""
    offsets = np.asarray(column.offsets, dtype=np.int64)
    sizes = np.diff(offsets)
    if column.null_count:
        valid = np.asarray(pc.is_valid(column))
        if sizes[~valid].any():  # null lists may hide elements
            keep = np.repeat(valid, sizes)
            values = column.values.slice(offsets[0], offsets[-1] - offsets[0]).filter(pa.array(keep))
            sizes = np.where(valid, sizes, 0)
        else:
            values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    else:
        values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    rows = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return rows, place, values


def _member(column: pa.Array, name: str) -> pa.Array:
    """A member of a struct column, null where the struct is null."""
    return pc.struct_field(column, name)


class Level(NamedTuple):
    """The rows reached after a list: their elements, and for each the row of every level above."""

    elements: pa.Array
    above: list[np.ndarray]
    place: list[np.ndarray]


def descend(batch: pa.RecordBatch, column: str, steps: list[str]) -> list[Level]:
    """The levels on the way from ``column`` along ``steps``; a step is a member's name or ``[]``."""
    here = batch.column(column)
    levels = [Level(here, [np.arange(batch.num_rows)], [])]
    for step in steps:
        if step == "[]":
            rows, place, here = _list_parts(here)
            last = levels[-1]
            levels.append(Level(here, [x[rows] for x in last.above] + [np.arange(len(place))], [x[rows] for x in last.place] + [place]))
        else:
            here = _member(here, step)
    return levels


def _steps(path: str) -> list[str]:
    return [p for part in path.split(".") for p in ([part[:-2], "[]"] if part.endswith("[]") else [part])]


def flatten_lists(df: DataFrame, keys: list[str], column: str, paths: dict[str, str], indexes: list[str], tag: str, carry: dict[str, str] | None = None, keep_null: bool = False) -> DataFrame:
    """Child tables of the same shape below the nested ``column``, one under the other, in one pass.

    ``paths`` has for each value of the column ``tag`` a path such as ``entries[].request.headers[]``
    that ends with a list; each row is one element, with the parents' ``keys``, an index column (from 0,
    over all elements, null ones included) for each list on the way, named by ``indexes``, and the
    element's scalar members (or ``value`` where the elements are scalars). ``carry`` takes members of
    the records above along: a name and a path such as ``entries[].request.url``. Members that are lists
    are tables of their own; a struct's scalar members come with the struct's name in front
    (``request_url``). Names that clash get ``_2`` behind them.

    Null, missing and empty lists give no rows; null elements give none either unless ``keep_null``.
    Rows with equal keys are kept apart only by their order, so keys should be unique. A null key is
    carried down like any other.
    """
    carry = carry or {}
    steps, kinds = {t: _steps(p) for t, p in paths.items()}, []
    for t, way in steps.items():
        if way[-1] != "[]" or way.count("[]") != len(indexes):
            raise ValueError(f"{paths[t]}: it must end with a list and have an index name for each list")
        kinds.append(_below(df.schema[column].dataType, way))
    leaves = [x for x in _leaves(kinds[0]) if all(x in _leaves(k) for k in kinds)]
    carried = {n: _steps(p) for n, p in carry.items()}
    taken, names = {*keys, *indexes, *carry, tag}, []
    for _, name in leaves:
        while name in taken:
            name += "_2"
        taken.add(name)
        names.append(name)
    schema = T.StructType([
        *[T.StructField(k, df.schema[k].dataType) for k in keys], *[T.StructField(i, T.IntegerType()) for i in indexes], T.StructField(tag, T.StringType()),
        *[T.StructField(n, _below(df.schema[column].dataType, w)) for n, w in carried.items()], *[T.StructField(n, _at(kinds[0], p)) for n, (p, _) in zip(names, leaves)],
    ])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, way in steps.items():
                levels = descend(batch, column, way)
                last = levels[-1]
                out = [batch.column(k).take(pa.array(last.above[0])) for k in keys] + [pa.array(x.astype(np.int32)) for x in last.place]
                out.append(pa.array([name]).take(pa.array(np.zeros(len(last.elements), np.int64))))
                for w in carried.values():
                    depth = w.count("[]")
                    x = levels[depth].elements
                    for member in w[len(w) - w[::-1].index("[]") if depth else 0 :]:
                        x = _member(x, member)
                    out.append(x.take(pa.array(last.above[depth])))
                for p, _ in leaves:
                    x = last.elements
                    for member in p:
                        x = _member(x, member)
                    out.append(x)
                rows = pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(out, arrow)], schema=arrow)
                yield rows if keep_null else rows.filter(pc.is_valid(last.elements))

    return df.select(*dict.fromkeys([*keys, column])).mapInArrow(run, schema)


def flatten(df: DataFrame, keys: list[str], column: str, path: str, indexes: list[str], carry: dict[str, str] | None = None, keep_null: bool = False) -> DataFrame:
    """The child table at ``path`` below the nested ``column``; see flatten_lists."""
    return flatten_lists(df, keys, column, {"": path}, indexes, "_list", carry, keep_null).drop("_list")


def _below(kind: T.DataType, steps: list[str]) -> T.DataType:
    for step in steps:
        kind = kind.elementType if step == "[]" else kind[step].dataType
    return kind


def _at(kind: T.DataType, path: tuple[str, ...]) -> T.DataType:
    for name in path:
        kind = kind[name].dataType
    return kind


def _leaves(kind: T.DataType, above: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], str]]:
    """The scalar members of a type and of the structs in it: path and flat name."""
    if not isinstance(kind, T.StructType):
        return [((), "value")]
    out = []
    for f in kind.fields:
        if isinstance(f.dataType, T.StructType):
            out += _leaves(f.dataType, (*above, f.name))
        elif not isinstance(f.dataType, T.ArrayType | T.MapType):
            out.append(((*above, f.name), "_".join((*above, f.name))))
    return out
