"""Column expressions shared by the operators of this subpackage. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word is a maximal run of anything but a space and the five ASCII line and tab controls.
SPACE = "[\\x20\\x09-\\x0D]+"
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text, in order; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def running_total(values: Column) -> Column:
    """Inclusive running totals of an array of whole numbers, in blocks so that cost stays near linear."""

    def total(xs):
        return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)

    def of_blocks(blocks):
        sums = F.transform(blocks, total)
        starts = F.aggregate(
            sums, F.array(F.lit(0).cast("long")), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s))
        )
        return F.flatten(
            F.zip_with(
                blocks,
                F.slice(starts, F.lit(1), F.size(blocks)),
                lambda block, start: F.transform(block, lambda x, i: start + total(F.slice(block, F.lit(1), i + 1))),
            )
        )

    def whole(xs):
        last = F.call_function("div", F.size(xs) - 1, F.lit(BLOCK))
        blocks = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda b: F.slice(xs, (b * BLOCK + 1).cast("int"), F.lit(BLOCK)))
        return let(blocks, of_blocks)

    none = F.array().cast("array<bigint>")
    return let(values, lambda xs: F.when(F.size(xs) > 0, whole(xs)).otherwise(none))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other letter as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
