"""What the corpus operators share: table access, text keys and batch plumbing.

Conventions of all operators in this package: a NULL text counts as the empty text; every
row is a document of its own, also when ids repeat; only the columns named in a docstring
are read, so further columns (whatever their names) are carried or ignored, never mixed up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that are worked on at a time inside a task (a longer text is taken whole).
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def digest(text: str = "text") -> Column:
    """16 bytes that identify a text; NULL and empty texts are equal."""
    return F.unhex(F.md5(F.encode(text_or_empty(text), "UTF-8")))


def same(left: DataFrame, right: DataFrame, names: dict[str, str]) -> Column:
    """NULL-safe equality of columns: name in ``left`` -> name in ``right``."""
    cond = F.lit(True)
    for a, b in names.items():
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it; Spark tells names apart without case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and their len + 1 offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def collected_bits(slots: DataFrame, size: int) -> np.ndarray:
    """The bits named by ``slots`` (slot, from 0 to ``size`` - 1) as 64-bit words.

    Slots are packed where they lie; at most ``size`` / 64 rows reach the driver.
    """
    packed = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")
    ).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[packed["word"].to_numpy()] = packed["bits"].to_numpy()
    return bits.view(U64)


def has_bit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bits at the given slots are set."""
    return ((bits[at >> 6] >> (at & 63).astype(U64)) & U64(1)).astype(bool)


def slices(batch: pa.RecordBatch, text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about ``size`` bytes of text each."""
    column = batch.column(batch.schema.get_field_index(text))
    _, at = text_buffer(column)
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(at, at[begin] + size, "right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def random_words(n: int, seed: int) -> np.ndarray:
    """``n`` fixed 64-bit values, the same everywhere."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed * 1_000_003)) * U64(0x9E3779B97F4A7C15))


def long_lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
