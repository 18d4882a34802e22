"""Structured fields of each document type, filled from entities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.fixed_values import FIELDS
from paperloom.operators import classify, scan
from paperloom.operators.entities import SLICE
from paperloom.shipping import ship_package, then_released


def field_rows() -> list[tuple[str, str, int, list[str], list[str]]]:
    """document type, field, its place among the type's fields, roles, entity types."""
    place: dict[str, int] = {}
    rows = []
    for kind, name, roles, types in FIELDS:
        rows.append((kind, name, place.get(kind, 0), list(roles), list(types)))
        place[kind] = place.get(kind, 0) + 1
    return rows


FIELD = "struct<field_ord:int,field_name:string,field_values:array<string>>"
#: field_ord, field_name, field_values
Filled = tuple[int, str, list[str]]


def _defined() -> dict[str, list[tuple[int, str, frozenset[str], frozenset[int]]]]:
    out: dict = {}
    for kind, name, i, roles, types in field_rows():
        out.setdefault(kind, []).append((i, name, frozenset(roles), frozenset(map(scan.KINDS.index, types))))
    return out


_DEFINED = _defined()


def filled(document_type: str | None, found: list[scan.Linked]) -> list[Filled]:
    """For each field of the document's type the values of entities with its role and type, else of those with its type; in the
    order of the text. Types without a schema have no fields."""
    defined = _DEFINED.get(document_type)
    if not defined:
        return []
    shaped = sorted([(a, i, k, r or "", n or x) for i, k, x, a, _, n, r in found])
    out = []
    for i, name, roles, types in defined:
        typed = [e for e in shaped if e[2] in types]
        out.append((i, name, [e[4] for e in [e for e in typed if e[3] in roles] or typed]))
    return out


def as_arrow(lists: list[list[Filled]]) -> pa.Array:
    """array<FIELD> of each document, null where it has none."""
    rows = [f for fs in lists for f in fs]
    i, names, values = zip(*rows) if rows else ((),) * 3
    texts = pa.ListArray.from_arrays(np.cumsum([0, *map(len, values)], dtype=np.int32), pa.array([v for vs in values for v in vs], pa.string()))
    parts = pa.StructArray.from_arrays((pa.array(i, pa.int32()), pa.array(names, pa.string()), texts), names=["field_ord", "field_name", "field_values"])
    ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
    offsets = pa.array(ends, pa.int32(), mask=np.array([*(not fs for fs in lists), False]))
    return pa.ListArray.from_arrays(offsets, parts)


def structured_fields(docs: DataFrame, doc_id: str = "doc_id", kind: str | None = "document_type", text: str = "text") -> DataFrame:
    """doc_id, field_name, field_ord, field_values: the fields of documents, filled from their entities. Types are those of a column,
    or (None) those of classify.rule_type.

    Each text is read once; nothing is joined.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.col(kind) if kind else F.lit(None).cast("string")).alias("kind"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            kinds = batch.column("kind").to_pylist() if kind else list(map(classify.rule_type, texts))
            for at in range(0, len(texts), SLICE):
                made = as_arrow([filled(k, scan.entities(t) if k in _DEFINED else []) for k, t in zip(kinds[at : at + SLICE], texts[at : at + SLICE])])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, SLICE), made], names=["doc_id", "f"])

    made = rows.mapInArrow(then_released(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, f array<{FIELD}>")
    return made.select("doc_id", F.explode("f").alias("f")).select("doc_id", "f.field_name", "f.field_ord", "f.field_values")
