"""Token lists changed in their row, by one Arrow lookup per batch against a small table.

Rows stay where they are: nothing is exploded, shuffled or regrouped, so rows of equal or missing ids stay apart. A null list
reads as an empty one, and null tokens vanish.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Most rows, and most bytes of text, of a table that is sent to every worker.
HELD_ROWS, HELD_BYTES = 200_000, 16 << 20


def held(df: DataFrame) -> list[Row] | None:
    """The rows of a table of strings, counted and measured first; None if they are too many or too long to send around."""
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)) for c in df.columns]
    total = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(sum(sizes[1:], sizes[0])), F.lit(0)).alias("b")).first()
    return df.collect() if total["n"] <= HELD_ROWS and total["b"] <= HELD_BYTES else None


def _rebuilt(lists: pa.Array, change: Callable[[pa.Array], tuple[pa.Array, np.ndarray]]) -> pa.Array:
    """Lists of changed tokens without those that change marks as gone."""
    ends = lists.offsets.to_numpy()
    flat, kept = change(lists.values.slice(ends[0], ends[-1] - ends[0]))
    before = np.concatenate([[0], np.cumsum(kept)])
    return pa.ListArray.from_arrays(pa.array(before[ends - ends[0]].astype(np.int32)), flat.filter(pa.array(kept)))


def _list_udf(change: Callable[[pa.Array], tuple[pa.Array, np.ndarray]]) -> Callable[[Column], Column]:
    @F.arrow_udf("array<string>")
    def changed(lists: pa.Array) -> pa.Array:
        return _rebuilt(lists, change)

    return lambda tokens: changed(F.coalesce(tokens, F.array().cast("array<string>")))


def without(df: DataFrame, tokens: Column, gone: list[str]) -> Column:
    """tokens without those listed in gone; order and repeats stay."""
    sent = df.sparkSession.sparkContext.broadcast(gone)
    made: list[pa.Array] = []

    def change(flat: pa.Array) -> tuple[pa.Array, np.ndarray]:
        if not made:
            made.append(pa.array(sent.value, flat.type))
        out = pc.or_(pc.is_in(flat, value_set=made[0]), pc.is_null(flat))
        return flat, ~out.to_numpy(zero_copy_only=False)

    return _list_udf(change)(tokens)


def replaced(df: DataFrame, tokens: Column, mapping: dict[str, str]) -> Column:
    """tokens with those that mapping names replaced, in place."""
    sent = df.sparkSession.sparkContext.broadcast((list(mapping), list(mapping.values())))
    made: list[tuple[pa.Array, pa.Array]] = []

    def change(flat: pa.Array) -> tuple[pa.Array, np.ndarray]:
        if not made:
            made.append(tuple(pa.array(side, flat.type) for side in sent.value))
        old, new = made[0]
        fixed = pc.coalesce(pc.take(new, pc.index_in(flat, value_set=old)), flat)
        return fixed, pc.is_valid(flat).to_numpy(zero_copy_only=False)

    return _list_udf(change)(tokens)
