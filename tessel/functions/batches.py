"""Rows and arrays in Arrow batches."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def starts(lists: pa.ListArray) -> np.ndarray:
    """Where each list begins in the flat values, and where the last one ends."""
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])


def _changes(values: pa.Array) -> np.ndarray:
    """For every value but the first, whether it differs from the one before."""
    codes = values.dictionary_encode().indices.fill_null(-1).to_numpy()
    return codes[1:] != codes[:-1]


def gathered(rows: DataFrame, keys: list[str], order: str, most: int, name: str, *columns: str) -> DataFrame:
    """``(<keys>, name)``: rows of the same keys as arrays of the columns, of ``most`` rows at most.

    Rows are sorted within their tasks, by a hash of the keys, a number, and cut where the keys change, at
    every ``most`` rows and at the end of a batch, so keys may have several arrays and no aggregate holds
    any.  Equal rows that follow each other in a batch are one.
    """
    dealt = rows.sortWithinPartitions(F.xxhash64(*keys), order).select(*keys, F.struct(*columns).alias(name))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            if not len(batch):
                continue
            first, new = np.ones(len(batch), bool), np.ones(len(batch), bool)
            first[1:] = np.logical_or.reduce([_changes(batch.column(k)) for k in keys])
            new[1:] = np.logical_or.reduce([first[1:], *[_changes(pc.struct_field(batch.column(name), c)) for c in columns]])
            kept = np.flatnonzero(new)
            n, begun = len(kept), np.flatnonzero(first[kept])
            begun = np.flatnonzero((np.arange(n) - np.repeat(begun, np.diff([*begun, n]))) % most == 0)
            at = pa.array(kept[begun])
            lists = pa.ListArray.from_arrays(pa.array([*begun, n], pa.int32()), batch.column(name).take(pa.array(kept)))
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in keys], lists], [*keys, name])

    out = StructType(list(dealt.schema)[:-1]).add(name, ArrayType(dealt.schema[name].dataType))
    return dealt.mapInArrow(batches, out)
