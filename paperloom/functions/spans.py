"""Matches with their places in a text, as arrays of structs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Private-use marks around a match and before its group; where a text has them, another one takes their place.
OPEN, CLOSE, GROUP, OTHER = "\ue000", "\ue001", "\ue002", "\ue003"
Step = Callable[[Column, Column], Column]
SPAN = "struct<text:string,start:int,end:int>"


#: Elements that are folded at a time.
BLOCK = 256


def gathered(items: Column, start: Column, kind: str, after: Step, found: Step, kept: Step | None = None) -> Column:
    """What found(state, item) gives for the items in order, for those that kept(state, item) holds for, as array<kind>.

    The state begins with start and goes on to after(state, item). An array that grows by one element at a time would be copied
    as often; so items are folded in blocks, whose results are joined.
    """
    none = F.array().cast(f"array<{kind}>")

    def step(a: Column, x: Column) -> Column:
        more = F.concat(a["out"], F.array(found(a["state"], x)))
        return F.struct(after(a["state"], x).alias("state"), (more if kept is None else F.when(kept(a["state"], x), more).otherwise(a["out"])).alias("out"))

    def block(a: Column, k: Column) -> Column:
        part = F.aggregate(F.slice(items, k * BLOCK + 1, F.lit(BLOCK)), F.struct(a["state"].alias("state"), none.alias("out")), step)
        # an array of one element binds the block's result, which is used twice
        joined = F.transform(F.array(part), lambda p: F.struct(p["state"].alias("state"), F.concat(a["out"], p["out"]).alias("out")))
        return F.element_at(joined, 1)

    blocks = F.sequence(F.lit(0), F.ceil(F.greatest(F.size(items), F.lit(1)) / BLOCK).cast("int") - 1)
    return F.aggregate(blocks, F.struct(start.alias("state"), none.alias("out")), block, lambda a: a["out"])


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spans(text: Column, pattern: str, group: bool = False) -> Column:
    """array<struct<text, start, end>> of all matches, left to right; with group, of their first group, which must end the match.

    Places count code points from 0; end is exclusive. Time grows in proportion to the text.
    """
    clean = F.regexp_replace(text, f"[{OPEN}{CLOSE}{GROUP}]", OTHER)
    marked = F.regexp_replace(clean, pattern, f"{OPEN}$0{GROUP}$1{CLOSE}" if group else f"{OPEN}$0{CLOSE}")
    # what is before a match, with the match: the last part has none and is left out
    pieces = F.split(marked, CLOSE)
    before = lambda p: F.substring_index(p, OPEN, 1)
    match = lambda p: F.substring_index(p, OPEN, -1)
    whole = lambda p: F.substring_index(match(p), GROUP, 1) if group else match(p)
    shown = lambda p: F.substring_index(match(p), GROUP, -1) if group else match(p)
    end = lambda at, p: (at + F.length(before(p)) + F.length(whole(p))).cast("int")
    span = lambda at, p: F.struct(shown(p).alias("text"), (end(at, p) - F.length(shown(p))).alias("start"), end(at, p).alias("end"))
    all_ = bound(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: gathered(p, F.lit(0), SPAN, end, span))
    return F.when(text.rlike(pattern), all_).otherwise(F.array().cast(f"array<{SPAN}>"))
