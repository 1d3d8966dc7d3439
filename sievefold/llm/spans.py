"""Places of regular-expression matches as Columns, with built-in functions only.

All folds over a text's matches go in blocks of CHUNK: appending to an array copies it, so that one fold over n
matches would take n * n steps. A block copies CHUNK elements at most, and blocks are joined once at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<s:int,e:int,m:string>"
SPANS = f"array<{SPAN}>"
WITHIN = "struct<s:int,e:int,m:string,before:string,after:string>"
ITEM = "struct<s:int,taken:int,e:int,score:double,kind:string,m:string>"
CHUNK = 512
LAST = 2_147_483_647


def running(items: Column, first: Column, step: Callable[[Column, Column], tuple[Column, Column]], of: str) -> Column:
    """What step emits, as one array, while it walks over items: step(state, item) gives the next state and an array."""
    none = F.array().cast(f"array<{of}>")

    def one(acc: Column, x: Column) -> Column:
        state, emitted = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], emitted).alias("out"))

    def whole(p: Column) -> Column:
        def block(acc: Column, k: Column) -> Column:
            done = lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out"))
            return F.aggregate(F.slice(p, k * CHUNK + 1, F.lit(CHUNK)), F.struct(acc["state"].alias("state"), none.alias("out")), one, done)

        start = F.struct(first.alias("state"), F.array().cast(f"array<array<{of}>>").alias("out"))
        blocks = F.sequence(F.lit(0), F.floor((F.size(p) - 1) / CHUNK).cast("int"))
        return F.flatten(F.aggregate(F.when(F.size(p) > 0, blocks).otherwise(F.array(F.lit(0))), start, block, lambda acc: acc["out"]))

    # bound once: the items are an argument here, not an expression that each block computes again
    return F.element_at(F.transform(F.array(items), whole), 1)


def found(text: Column, pattern: str, likely: Column) -> Column:
    """Array of (s, e, m): start, end (exclusive) in code points, and text of each match from the left.

    What lies between matches (split) and the matches (regexp_extract_all) alternate, so that running
    lengths give the places. likely: a cheap test that holds for every text with a match.
    """
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        s = at + F.length(x["gap"])
        e = s + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))
        return e, F.when(x["m"].isNull(), F.array().cast(SPANS)).otherwise(span)

    return F.when(likely, running(parts, F.lit(0), step, SPAN)).otherwise(F.array().cast(SPANS))


def found_within(text: Column, pattern: str, likely: Column, before: int, after: int) -> Column:
    """As found, with the code points before and after each match, up to the match that follows the next gap.

    They come from the gaps that the walk passes; to cut them out of the text would walk through it for each match.
    """

    def of(p: Column) -> Column:
        nexts = F.concat(F.slice(p["gap"], F.lit(2), F.size(p["gap"])), F.array(F.lit("")))
        parts = F.arrays_zip(p["gap"].alias("gap"), p["m"].alias("m"), nexts.alias("next"))

        def step(state: Column, x: Column) -> tuple[Column, Column]:
            s = state["at"] + F.length(x["gap"])
            m = F.coalesce(x["m"], F.lit(""))
            tail = F.concat(state["tail"], F.right(x["gap"], F.lit(before)))
            span = F.struct(s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m"), F.right(tail, F.lit(before)).alias("before"), F.left(x["next"], F.lit(after)).alias("after"))
            after_it = F.struct((s + F.length(m)).alias("at"), F.right(F.concat(tail, m), F.lit(before)).alias("tail"))
            return after_it, F.when(x["m"].isNull(), F.array().cast(f"array<{WITHIN}>")).otherwise(F.array(span))

        return running(parts, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")), step, WITHIN)

    both = F.struct(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    return F.when(likely, F.element_at(F.transform(F.array(both), of), 1)).otherwise(F.array().cast(f"array<{WITHIN}>"))


def best_apart(taken: Column, further: Column) -> Column:
    """Of the further items (ITEM) those that overlap none taken, and of ones that overlap each other the better.

    One walk over all in the order of their starts: a further item waits until the next one that starts at or
    after its end; a taken one that starts before that removes it. Of equal scores the earlier stays.
    """
    order = F.array_sort(F.concat(taken, further))
    sentinel = F.array(F.struct(F.lit(LAST).alias("s"), F.lit(1).alias("taken"), F.lit(LAST).alias("e"), F.lit(0.0).alias("score"), F.lit("").alias("kind"), F.lit("").alias("m")).cast(ITEM))
    empty, nothing = F.array().cast(f"array<{ITEM}>"), F.lit(None).cast(ITEM)

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        waiting = state["waiting"]
        free = waiting.isNull() | (waiting["e"] <= x["s"])
        base = x["taken"] == 0
        dead = ~base & (x["s"] < state["end"])
        after_base = F.when(free, waiting).otherwise(nothing)
        after_further = F.when(dead, waiting).when(free | (x["score"] > waiting["score"]), x).otherwise(waiting)
        end = F.when(base, F.greatest(state["end"], x["e"])).otherwise(state["end"])
        emitted = F.when(~base & ~dead & free & waiting.isNotNull(), F.array(waiting)).otherwise(empty)
        return F.struct(end.alias("end"), F.when(base, after_base).otherwise(after_further).alias("waiting")), emitted

    return running(F.concat(order, sentinel), F.struct(F.lit(0).alias("end"), nothing.alias("waiting")), step, ITEM)


def item(x: Column, kind: str | Column, *, taken: bool, score: Column | None = None) -> Column:
    """A span as an item of best_apart."""
    score = F.lit(0.0) if score is None else score
    return F.struct(x["s"].alias("s"), F.lit(int(not taken)).alias("taken"), x["e"].alias("e"), score.alias("score"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), x["m"].alias("m"))


def as_taken(kind: str) -> Column:
    """The spans in the column named kind as items that stay."""
    return F.transform(F.col(kind), lambda x: item(x, kind, taken=True))


def kind_of(spans: Column, kind: str, order: int) -> Column:
    """The same spans with their kind and its place in the list of kinds."""
    return F.transform(spans, lambda x: F.struct(F.lit(order).alias("o"), x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind"), x["m"].alias("m")))


def joined(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
