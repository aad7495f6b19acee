"""Arrow plumbing of the training-data operators.

Per-document operators run as one `mapInArrow` pass over whole texts. Spark's Arrow batches are cut here into slices of a bounded
number of text bytes, so a worker's memory depends on the slice (or on one longer text), never on the partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.runtime import ensure_workers

#: Bytes of text, and texts, handled at once.
SLICE_BYTES, SLICE_ROWS = 2 << 20, 4096


def ref(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def slices(batch: pa.RecordBatch, texts: pa.Array, limit: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Consecutive runs of at most SLICE_ROWS rows whose texts have at most `limit` bytes together, or one row that has more."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
    ends = np.cumsum(sizes)
    at, done = 0, 0
    while at < len(ends):
        to = max(at + 1, min(at + SLICE_ROWS, int(np.searchsorted(ends, done + limit, side="right"))))
        yield batch.slice(at, to - at), texts.slice(at, to - at)
        at, done = to, int(ends[to - 1])


def map_texts(
    df: DataFrame,
    text_col: str,
    keep: list[str],
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.Array, pa.RecordBatch], list[pa.Array]]],
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """The columns `keep` of df, then `fields` worked out from whole texts.

    `make` runs once per task and returns the function of a slice: (texts, its rows) to one Arrow array per field. Any other column of
    df is left out before rows go to Python, so names that clash with `fields` do no harm unless they are in `keep` (an error).
    """
    ensure_workers(df.sparkSession)
    clash = {f.name for f in fields} & set(keep)
    if clash:
        raise ValueError(f"columns to keep clash with results: {sorted(clash)}")
    kept = [next(f for f in df.schema.fields if f.name == c) for c in keep]
    whole = T.StructType(kept + fields)
    names = [f.name for f in whole.fields]
    at = keep.index(text_col) if text_col in keep else len(keep)
    chosen = [ref(c).alias(f"c{i}") for i, c in enumerate(keep)]
    if at == len(keep):
        chosen.append(ref(text_col).cast("string").alias("text"))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            for part, texts in slices(batch, batch.column(at), limit):
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n)), *work(texts, part)], names=names)

    return df.select(*chosen).mapInArrow(run, whole)


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text, without decoding; null: empty."""
    return [b or b"" for b in texts.cast(pa.binary()).to_pylist()]


def list_array(counts: np.ndarray, values: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def row_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts end to end, where each text begins and the last ends); null: empty."""
    data = b"".join(as_bytes(texts))
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum(sizes)])
