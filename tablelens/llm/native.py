"""Positions of pattern matches as SQL expressions (no Python in the tasks)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefix sums are built in blocks of this many matches, so long lists stay cheap.
_BLOCK = 128


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: inside lambda functions an expression would
    be computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_sums(values: Column) -> Column:
    """Inclusive prefix sums of a non-empty array of int, itself a variable or column."""
    add = lambda a, x: a + x
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")),
        lambda b: F.aggregate(F.slice(values, b * _BLOCK + 1, _BLOCK), F.lit(0), add),
    )
    # sums of all blocks before each block
    before = F.aggregate(
        blocks,
        F.struct(F.array(F.lit(0)).alias("sums"), F.lit(0).alias("last")),
        lambda a, x: F.struct(F.concat(a["sums"], F.array(a["last"] + x)).alias("sums"), (a["last"] + x).alias("last")),
    )["sums"]
    return let(
        before,
        lambda sums: F.transform(
            values,
            lambda _, i: F.get(sums, F.floor(i / _BLOCK).cast("int"))
            + F.aggregate(F.slice(values, (F.floor(i / _BLOCK) * _BLOCK + 1).cast("int"), (i % _BLOCK + 1).cast("int")), F.lit(0), add),
        ),
    )


def earlier_max(values: Column) -> Column:
    """The largest of all earlier elements (0 for the first one) for every element of a
    non-empty array of non-negative int, itself a variable or column."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")),
        lambda b: F.array_max(F.slice(values, b * _BLOCK + 1, _BLOCK)),
    )
    # the largest of all blocks before each block
    before = F.aggregate(
        blocks,
        F.struct(F.array(F.lit(0)).alias("seen"), F.lit(0).alias("last")),
        lambda a, x: F.struct(
            F.concat(a["seen"], F.array(F.greatest(a["last"], x))).alias("seen"), F.greatest(a["last"], x).alias("last")
        ),
    )["seen"]
    return let(
        before,
        lambda seen: F.transform(
            values,
            lambda _, i: F.greatest(
                F.get(seen, F.floor(i / _BLOCK).cast("int")),
                F.array_max(F.slice(values, (F.floor(i / _BLOCK) * _BLOCK + 1).cast("int"), (i % _BLOCK).cast("int"))),
            ),
        ),
    )


#: Code points of a piece of text.
_PIECE = 512


def pieces(text: Column) -> Column:
    """The text cut into equal pieces, so that a part of it is reached without walking there."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))


def part(cut: Column, start: Column, length: Column) -> Column:
    """`length` code points from `start` (from 0) of a text cut by `pieces`."""
    first = F.floor(start / _PIECE)
    count = F.floor((start + length - 1) / _PIECE) - first + 1
    few = F.array_join(F.slice(cut, (first + 1).cast("int"), count.cast("int")), "")
    return F.substring(few, (start % _PIECE + 1).cast("int"), length.cast("int"))


def matches(text: Column, pattern: str, kind: str, rank: int, maybe: Column | None = None) -> Column:
    """array<struct<start, rank, end, kind, value>> of the leftmost non-overlapping matches,
    in code points, end exclusive. `maybe` is a cheap test that every text with a match
    passes.

    Splitting at the pattern gives the texts between the matches; the lengths of both add
    up to the positions."""

    def spans(found: Column, starts: Column) -> Column:
        return F.transform(
            found,
            lambda value, i: F.struct(
                F.get(starts, i).alias("start"),
                F.lit(rank).alias("rank"),
                (F.get(starts, i) + F.char_length(value)).alias("end"),
                F.lit(kind).alias("kind"),
                value.alias("value"),
            ),
        )

    def steps(both: Column) -> Column:
        return F.transform(
            both["found"],
            lambda _, i: F.char_length(F.get(both["between"], i)) + F.when(i > 0, F.char_length(F.get(both["found"], i - 1))).otherwise(0),
        )

    both = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between")
    )
    found = let(both, lambda b: let(steps(b), lambda s: let(prefix_sums(s), lambda starts: spans(b["found"], starts))))
    test = text.rlike(pattern) if maybe is None else maybe & text.rlike(pattern)
    return F.when(test, found).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>"))
