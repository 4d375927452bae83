"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The whitespace of the word and line contracts, ``[\x20\x09-\x0D]``.
WHITE = " \t\n\x0b\x0c\r"
#: Lower-cases A-Z and leaves every other byte, so it is safe on UTF-8.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def map_rows(df: DataFrame, inputs: list[str], outputs: dict[str, T.DataType], rows) -> DataFrame:
    """Every input row with result columns added, computed batch by batch inside the tasks.

    ``rows`` takes one Python list per column of ``inputs`` and returns one list (or array) per result. An input column that has
    the name of a result is replaced by it; all others pass through untouched.
    """
    taken = {name.lower() for name in outputs}
    kept = [f for f in df.schema.fields if f.name.lower() not in taken]
    schema = T.StructType(kept + [T.StructField(name, kind) for name, kind in outputs.items()])
    from pyspark.sql.pandas.types import to_arrow_type
    kinds = [to_arrow_type(kind) for kind in outputs.values()]
    names = [f.name for f in kept]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = rows(*[part.column(name).to_pylist() for name in inputs])
                arrays = [part.column(name) for name in names] + [pa.array(x, kind) for x, kind in zip(made, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names + list(outputs))

    return df.mapInArrow(run, schema)


def pack(records: DataFrame, *used: str) -> DataFrame:
    """The columns an operator works on, and all others in one column ``_rest``, where their names clash with nothing."""
    rest = [F.col(f"`{c}`") for c in records.columns if c not in used] or [F.lit(None).cast("string").alias("_")]
    return records.select(*used, F.struct(*rest).alias("_rest"))


def unpack(result: DataFrame, records: DataFrame, made: list[str], dropped: tuple[str, ...] = ()) -> DataFrame:
    """Columns of ``records`` in their order, but for ``dropped`` ones and those that a result replaces, and then the results."""
    names = [c for c in records.columns if c not in dropped and c.lower() not in {m.lower() for m in made}]
    packed = set(result.schema["_rest"].dataType.names)
    return result.select(*[F.col(f"_rest.`{c}`" if c in packed else f"`{c}`").alias(c) for c in names], *made)


def slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch cut into pieces of about ``most`` bytes, so that long texts do not pile up in a worker; one row is never cut."""
    if batch.num_rows and batch.nbytes > most:
        step = max(1, batch.num_rows * most // batch.nbytes)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    else:
        yield batch


def mix64(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """Name of a pair of 64-bit names (wrap-around multiplications and shifts)."""
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x += b
    x ^= np.uint64(salt)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x

