"""Entity recognition, containment dedup and roles, as columns over whole texts.

Classes and digits are ASCII; word boundaries are the engine's. Each recogniser gives all its matches; of entities whose span
lies in another's, the longer one stays, of equal spans the first recognised. Streams use the columns; tables are read by scan.py.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.fixed_values import RECOGNISERS, ROLE_CONTEXT, ROLE_LABEL, ROLE_RULES
from paperloom.functions.spans import bound, gathered, spans
from paperloom.operators import scan
from paperloom.shipping import ship_package, then_released

#: Texts whose entities are in memory at a time.
SLICE = 1_000

TRIMMED = ("address", "organization")
#: What ROLE_LABEL can have: 31 characters, and white space between them and the colon counts too.
_LONGEST_LABEL = 200
ENTITY = "struct<ord:int,text:string,entity_type:string,start:int,end:int,confidence:double,normalized:string>"
#: The first three letters of the months, one after another.
_MONTH_KEY = "janfebmaraprmayjunjulaugsepoctnovdec"


def iso_date(raw: Column) -> Column:
    """yyyy-MM-dd of a recognised date, month first where both are possible, or null."""
    v = F.regexp_replace(F.regexp_replace(raw, r"\s+", " "), ",$", "")
    part = lambda p, g: F.regexp_extract(v, p, g)
    two = lambda x: F.lpad(x, 2, "0")
    real = lambda y, m, d: F.date_format(F.try_to_timestamp(F.concat_ws("-", y, two(m), two(d)), F.lit("yyyy-MM-dd")), "yyyy-MM-dd")
    slash = r"^(\d{1,2})/(\d{1,2})/(\d+)$"
    a, b, y = (part(slash, i) for i in (1, 2, 3))
    short = F.when(y.try_cast("int") >= 69, F.concat(F.lit("19"), y)).otherwise(F.concat(F.lit("20"), y))
    named, turned = r"^([A-Za-z]+) (\d{1,2}),? (\d{4})$", r"^(\d{1,2}) ([A-Za-z]+) (\d{4})$"
    number = lambda name: _month_number(name).cast("string")
    return (
        F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), real(part(r"^(\d+)-(\d+)-(\d+)$", 1), part(r"^(\d+)-(\d+)-(\d+)$", 2), part(r"^(\d+)-(\d+)-(\d+)$", 3)))
        .when(v.rlike(slash) & (F.length(y) == 4), F.coalesce(real(y, a, b), real(y, b, a)))
        .when(v.rlike(slash) & (F.length(y) == 2), real(short, a, b))
        .when(v.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), real(part(r"^(\d+)\.(\d+)\.(\d+)$", 3), part(r"^(\d+)\.(\d+)\.(\d+)$", 2), part(r"^(\d+)\.(\d+)\.(\d+)$", 1)))
        .when(v.rlike(named), real(part(named, 3), number(part(named, 1)), part(named, 2)))
        .when(v.rlike(turned), real(part(turned, 3), number(part(turned, 2)), part(turned, 1)))
    )


def _month_number(name: Column) -> Column:
    return ((F.call_function("locate", F.lower(F.substring(name, 1, 3)), F.lit(_MONTH_KEY)) + 2) / 3).cast("int")


def normalised(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.lower(text)
    if kind == "date":
        return iso_date(text)
    if kind == "amount":
        return F.nullif(F.regexp_replace(text, r"[^\d.]", ""), F.lit(""))
    if kind == "phone":
        return F.regexp_replace(text, r"\D", "")
    if kind == "reference_number":
        return F.upper(text)
    return text if kind == "person" else F.lit(None).cast("string")


def recognised(text: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """All entities of a text in order of recognition (ord), before dedup."""
    arrays = []
    for kind, confidence, patterns, group in RECOGNISERS:
        if kinds and kind not in kinds:
            continue
        found = F.concat(*(spans(text, p, group) for p in patterns))
        if kind == "reference_number":
            found = _first_of_each_text(found)
        shown = (lambda x: F.regexp_replace(x["text"], r"^\s+|\s+$", "")) if kind in TRIMMED else (lambda x: x["text"])
        made = F.transform(found, _entity(kind, confidence, shown))
        if kind == "organization":
            made = F.filter(made, lambda e: F.length(e["text"]) >= 5)
        arrays.append(made)
    all_ = F.concat(*arrays)
    numbered = F.transform(all_, lambda e, i: F.struct(i.cast("int").alias("ord"), *(e[k].alias(k) for k in ("text", "entity_type", "start", "end", "confidence", "normalized"))))
    return F.when(text.isNull() | (text == ""), F.array().cast(f"array<{ENTITY}>")).otherwise(numbered)


def _entity(kind: str, confidence: float, shown):
    return lambda x: F.struct(
        shown(x).alias("text"), F.lit(kind).alias("entity_type"), x["start"].alias("start"), x["end"].alias("end"), F.lit(confidence).alias("confidence"), normalised(kind, shown(x)).alias("normalized")
    )


def _first_of_each_text(found: Column) -> Column:
    """Of matches with equal texts the first, in their order: sorted by text and place, each that follows another text stays."""
    numbered = F.array_sort(F.transform(found, lambda x, i: F.struct(x["text"].alias("t"), i.alias("i"), x.alias("x"))))
    new = lambda s: F.filter(s, lambda y, k: (k == 0) | (F.get(s, k - 1)["t"] != y["t"]))
    firsts = F.array_sort(F.transform(bound(numbered, new), lambda y: F.struct(y["i"].alias("i"), y["x"].alias("x"))))
    return F.transform(firsts, lambda y: y["x"])


def deduplicated(entities: Column) -> Column:
    """Entities that lie in no longer (or equal, earlier) one, by start; one sweep with the furthest end so far."""
    swept = F.array_sort(F.transform(entities, lambda e: F.struct(e["start"].alias("s"), (-e["end"]).alias("n"), e["ord"].alias("o"), e.alias("e"))))
    further = lambda far, x: x["e"]["end"] > far
    return bound(
        swept,
        lambda xs: gathered(xs, F.lit(-1), ENTITY, lambda far, x: F.greatest(far, x["e"]["end"]), lambda _, x: x["e"], further),
    )


def role_of(context: Column, line: Column, kind: Column) -> Column:
    """A role by rules, else field:<label> where the line before the entity is just a label, else null."""
    out = None
    for phrases, k, role in ROLE_RULES:
        hit = functools.reduce(lambda a, b: a | b, (context.contains(p) for p in phrases))
        out = F.when((kind == k) & hit, role) if out is None else out.when((kind == k) & hit, role)
    label = F.regexp_replace(F.regexp_extract(line, ROLE_LABEL, 1), r"\s+$", "")
    return out.when(line.rlike(ROLE_LABEL), F.concat(F.lit("field:"), label))


NAMES = ("ord", "text", "entity_type", "start", "end", "confidence", "normalized")


#: A label and the white space around it seldom take more; where they do, the whole line is looked at.
_NEAR = 256


def _before(text: Column, start: Column) -> tuple[Column, Column]:
    """The 60 characters before an entity and its line up to it, both in lower case. Of lines that are too long for a label, only
    the last _NEAR characters are read, which then aren't one either."""
    last = lambda n: F.substring(text, F.greatest(start - n, F.lit(0)) + 1, F.least(start, F.lit(n)))
    line = lambda t: F.regexp_replace(F.lower(F.substring_index(t, "\n", -1)), r"^\s+|\s+$", "")
    near = last(_NEAR)
    cut_off = (start > _NEAR) & ~near.contains("\n") & (F.length(line(near)) <= _LONGEST_LABEL)
    return F.lower(last(ROLE_CONTEXT)), F.when(cut_off, line(F.substring(text, F.lit(1), start))).otherwise(line(near))


def linked(text: Column, entities: Column) -> Column:
    """The entities of an array with their roles; for streams, which have no rows per entity."""
    return F.transform(entities, lambda e: F.struct(*(e[k].alias(k) for k in NAMES), role_of(*_before(text, e["start"]), e["entity_type"]).alias("role")))


def entity_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", dedup: bool = True, link: bool = True, kinds: tuple[str, ...] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per entity: doc_id, the columns to keep, ord, text, entity_type, start, end, confidence, normalized, role.

    The same as the columns above, but each text is read by scan.py in Arrow batches.
    """
    rows = with_entities(docs.select(F.col(doc_id).alias("doc_id"), *keep, F.col(text).alias("__t")), "__t", dedup, link, kinds)
    return rows.select("doc_id", *keep, F.explode("entities").alias("e")).select("doc_id", *keep, "e.*")


def with_entities(rows: DataFrame, text: str, dedup: bool = True, link: bool = True, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """The rows with their entities, array<scan.ENTITY>, in place of their texts."""
    ship_package(rows.sparkSession)
    wanted = frozenset(map(scan.KINDS.index, kinds)) if kinds else None
    kept = [c for c in rows.columns if c != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text), f"entities array<{scan.ENTITY}>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for at in range(0, len(texts), SLICE):
                found = scan.as_arrow([scan.entities(t, dedup, link, wanted) for t in texts[at : at + SLICE]])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, SLICE) for c in kept), found], names=[*kept, "entities"])

    return rows.select(*kept, text).mapInArrow(then_released(run), schema)
