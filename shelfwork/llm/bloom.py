"""A Bloom filter of fixed size over 64-bit keys, gathered by Spark: whatever the number of keys, 2 ** BITS bits are broadcast."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwork.llm import buffers

BITS = 24


def places(key: np.ndarray) -> np.ndarray:
    """Three bit positions for each key."""
    h = buffers.mix(key.astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15))
    return np.stack([(h >> np.uint64(k)) & np.uint64((1 << BITS) - 1) for k in (0, 19, 38)])


def _words(batches):
    for batch in batches:
        place = places(batch.column(0).to_numpy()).ravel()
        word, at = np.unique(place >> np.uint64(6), return_inverse=True)
        bits = np.zeros(len(word), np.uint64)
        np.bitwise_or.at(bits, at, np.uint64(1) << (place & np.uint64(63)))
        yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])


def gather(keys: DataFrame) -> np.ndarray:
    """The filter of the first column of ``keys`` (long, no nulls)."""
    words = keys.mapInArrow(_words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (BITS - 6), np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return table


def maybe(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    """False: surely not among the keys."""
    place = places(key)
    return (((table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)) == 1).all(axis=0)


def among(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose first column is among the first of ``keys`` (long, no nulls), and a few others."""
    table = rows.sparkSession.sparkContext.broadcast(gather(keys))

    def run(batches):
        for batch in batches:
            hit = np.flatnonzero(maybe(table.value, batch.column(0).to_numpy().view(np.uint64)))
            if len(hit):
                yield batch.take(pa.array(hit))

    return rows.mapInArrow(run, rows.schema)
