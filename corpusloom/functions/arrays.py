"""Array expressions that stay linear in the length of the array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import let

# An array cannot be appended to in place, so sums run inside blocks of so many elements.
BLOCK = 256


def running_sums(values: Column) -> Column:
    """Sums of all earlier elements."""

    def inside(block: Column) -> Column:
        zero = F.array(F.lit(0).cast("long"))
        return F.aggregate(block, zero, lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))

    def whole(all_values: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(all_values) - 1) / BLOCK).cast("int")),
            lambda b: inside(F.slice(all_values, b * BLOCK + 1, F.lit(BLOCK))),
        )

        def shifted(parts: Column) -> Column:
            before = inside(F.transform(parts, lambda p: F.element_at(p, -1)))
            moved = F.transform(
                parts,
                lambda p, k: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: x + F.get(before, k)),
            )
            return F.flatten(moved)

        return let(blocks, shifted)

    return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(let(values, whole))
