"""Small helpers of the text operators: column picking, packed rows, hashing, size estimates."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands for a missing id inside packed rows; sorts after every real id.
NO_ID = np.iinfo(np.int64).max

#: ASCII white space, the separators of words.
SPACES = " \t\n\x0b\x0c\r"


def place_of(df: DataFrame, name: str) -> int | None:
    """The first column of that name, else the first that differs in case only; nothing where there is none."""
    if name in df.columns:
        return df.columns.index(name)
    return next((i for i, c in enumerate(df.columns) if c.lower() == name.lower()), None)


def by_place(df: DataFrame) -> DataFrame:
    """``df`` with the columns ``c0``, ``c1`` and so on, so that any name can be added; ``renamed`` undoes it."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def renamed(plain: DataFrame, df: DataFrame) -> DataFrame:
    """The columns ``c0``, ``c1`` ... of ``plain`` under their names in ``df``; others go."""
    return plain.select(*[f"c{i}" for i in range(len(df.columns))]).toDF(*df.columns)


def text_key(plain: DataFrame, df: DataFrame):
    """``xxhash64`` of the text, a missing one as empty, among the columns of ``by_place(df)``."""
    return F.xxhash64(F.coalesce(plain[f"c{place_of(df, 'text')}"], F.lit("")))


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast; extra columns, whatever they are called, are left behind."""
    return by_place(df).select(*[F.col(f"c{place_of(df, n)}").cast(k).alias(n) for n, k in kinds.items()])


#: Bits of a bitmap of hashes: 4 MB, whatever the number of keys.
BITMAP = 1 << 25


def maybe_among(keys: DataFrame, name: str):
    """A test for rows: false where the 64-bit hash ``name`` is surely not in ``keys``.

    The bitmap that is sent to the tasks has a fixed size; the fuller it is, the more rows pass. So a join with
    ``keys`` moves only the rows that pass, however large the table is.
    """
    bit = F.pmod(F.col(name), F.lit(BITMAP)) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    whole = np.zeros(BITMAP // 8, np.uint8)
    for part, bits in parts:
        whole[4096 * (part - 1):4096 * part] = np.frombuffer(bits, np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(whole)

    @F.pandas_udf("boolean")
    def test(hashes: pd.Series) -> pd.Series:
        at = hashes.to_numpy(np.int64) % BITMAP
        return pd.Series((shared.value[at >> 3] >> (at & 7) & 1).astype(bool))

    return test


def mix(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit value of each 64-bit value."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; dtypes are kept by ``unsqueeze``."""
    head = np.array([len(arrays)] + [a.nbytes for a in arrays], np.int64).tobytes()
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays]  # like bytes together
    return zstandard.ZstdCompressor(6).compress(head + b"".join(planes))


def unsqueeze(blob: bytes, *dtypes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(raw, np.int64, n, 8), 8 * (n + 1), []
    for size, kind in zip(sizes, dtypes, strict=True):
        wide = np.dtype(kind).itemsize
        plane = np.frombuffer(raw, np.uint8, int(size), at).reshape(wide, -1)
        out.append((plane[0] if wide == 1 else np.ascontiguousarray(plane.T).reshape(-1)).view(kind))
        at += int(size)
    return out


def ids_of(col) -> np.ndarray:
    """An Arrow id column as int64, ``NO_ID`` where missing."""
    return col.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def ids_back(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def steps(a: np.ndarray) -> np.ndarray:
    """Differences of neighbours, which compress better; ``np.cumsum`` undoes them."""
    return np.diff(a, prepend=a.dtype.type(0))


def give_back() -> None:
    """Return memory that this worker has freed to the system: workers serve many stages and would keep what the largest one used."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def lean(step):
    """A step of ``mapInArrow`` that starts and ends with no freed memory held."""

    @functools.wraps(step)
    def run(batches):
        give_back()
        yield from step(batches)
        give_back()

    return run
