"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.session import cut, shared_dir  # noqa: F401
from marlstone.sources.tables import table  # noqa: F401

#: What counts as white space between words, for every operator.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    """Number of words of a text; null counts as empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def absent(df: DataFrame, name: str) -> str:
    """The name, with more underscores where the table has a column of that name."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def slices(texts: list[bytes], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about `most` bytes together; a longer text stands alone."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def spread_rank(df: DataFrame, key: list[str], order: list[str], salt: Column, weight: Column | None = None, into: str = "rank", carry: DataFrame | None = None) -> DataFrame:
    """Adds `into`: how much weight (rows, if None) stands before each row among the rows of its key.

    No key is gathered in one task: the rows of a key are dealt over groups by `salt`, ranked inside each, and shifted
    by what the key's earlier groups hold. The order is that of salt, then `order`. carry: a table with one row per key,
    whose other columns are added on the way, so that a hot key isn't joined by itself. An empty table gives an empty one;
    the rows must have no columns named `_salt`, `_w`, `_in`, `_n`, `_s`, `_before` or `_k0` and on, so callers pass narrow rows.
    """
    w = F.lit(1).cast("long") if weight is None else weight.cast("long")
    df = df.withColumn("_salt", salt.cast("int")).withColumn("_w", w)
    sums = df.groupBy(*key, "_salt").agg(F.sum("_w").alias("_n"))
    before = Window.partitionBy(*key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_salt").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    if carry is not None:
        extra = [c for c in carry.columns if c not in key]
        other = carry.select(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(key)], *extra)
        same = F.lit(True)
        for i in range(len(key)):
            same = same & F.col(f"_k{i}").eqNullSafe(F.col(f"_c{i}"))
        sums = sums.join(other, same).drop(*[f"_c{i}" for i in range(len(key))])
    on = F.col("_salt") == F.col("_s")
    for i, k in enumerate(key):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inner = Window.partitionBy(*key, "_salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = df.withColumn("_in", F.coalesce(F.sum("_w").over(inner), F.lit(0)))
    out = ranked.join(sums, on).withColumn(into, F.col("_before") + F.col("_in"))
    return out.drop("_salt", "_w", "_in", "_s", "_before", *[f"_k{i}" for i in range(len(key))])


def splitmix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def eights(raw: bytes) -> np.ndarray:
    """The eight bytes from each place of `raw` on, as an integer; zeros follow its end."""
    return np.ndarray(len(raw) + 1, "<u8", raw + bytes(8), strides=(1,))


def same_bytes(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether `size` bytes from a on in x and from b on in y agree; x and y by `eights`."""
    out, todo, off = np.ones(len(size), bool), np.flatnonzero(size), 0
    while len(todo):
        left = size[todo] - off
        mask = ~np.uint64(0) >> (8 * np.maximum(8 - left, 0)).astype(np.uint64)
        same = ((x[a[todo] + off] ^ y[b[todo] + off]) & mask) == 0
        out[todo[~same]] = False
        todo, off = todo[same & (left > 8)], off + 8
        if off >= 512:  # what is still left are a few long ranges
            for i in todo.tolist():
                for k in range(off, int(size[i]), 8 << 13):
                    n = min(8 << 13, int(size[i]) - k)
                    u, v = (z[int(p[i]) + k : int(p[i]) + k + n - 7 : 8] for z, p in ((x, a), (y, b)))
                    end = n - n % 8
                    u_end, v_end = (int(z[int(p[i]) + k + end]) & ((1 << 8 * (n - end)) - 1) if n > end else 0 for z, p in ((x, a), (y, b)))
                    if u_end != v_end or not np.array_equal(u, v):
                        out[i] = False
                        break
            break
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def batches(frames: Iterable[pa.RecordBatch], most: int = 4096) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `most`, so that memory doesn't follow the caller's batch size."""
    for b in frames:
        for i in range(0, b.num_rows, most):
            yield b.slice(i, most)
