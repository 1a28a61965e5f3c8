"""Whitening of embeddings by the principal axes of their distinct grid points.

A vector becomes the integers x = floor(64 * c) + 1000000. The fit list holds each distinct x once. Its sums are exact, and
n * x - S is an exact integer, so rows are centred exactly before they are rounded once to doubles. MLlib's RowMatrix adds up
their Gramian in a tree; divided by n it is the covariance, small enough for a local `eigh`. The axes are broadcast (one
number per dimension and component) and rows are projected in Arrow batches, with no shuffle. The offset of 1000000 cancels
in n * x - S, so grid values are held without it, in the narrowest integers that fit.

Rows whose vector is null or has null or non-finite entries are left out. So are rows of another length than the commonest
(ties: the longer) and empty vectors. Entries beyond 2**53 grid steps count as 2**53. Repeated vectors count once in the fit,
and each has its result. A component without variance (or lost in rounding) has null for `whitened` and takes no part in
`identity_error`, which is null where no component is left; `explained` is null where there is no variance at all. A
deviation too large for its type is null. An empty table, or none but rows left out, gives an empty one. Other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import cut, table

STEPS, OFFSET, COMPONENTS = 64, 1000000, 16
FAR = 2.0**53


@dataclass(frozen=True)
class Whitening:
    """n, and per dimension the sum of grid values; eigenvalues of all components; unit axes (dimension by component) of the first ones."""

    n: int
    sums: list[int]
    reach: int
    kind: str
    eigenvalues: np.ndarray
    axes: np.ndarray
    identity_error: float | None

    @property
    def sound(self) -> np.ndarray:
        """Which of the axes have a variance above rounding."""
        e = self.eigenvalues
        return e[: self.axes.shape[1]] > max(e[0], 0) * len(e) * np.finfo(float).eps

    @property
    def explained(self) -> list[float | None]:
        total = float(self.eigenvalues.sum())
        return [float(e) / total if total > 0 else None for e in self.eigenvalues[: self.axes.shape[1]]]


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))


def grid(vector: Column, kind: str = "bigint") -> Column:
    """floor(64 * c) of each entry."""
    return F.transform(vector, lambda c: F.floor(F.least(F.greatest(c.cast("double") * STEPS, F.lit(-FAR)), F.lit(FAR))).cast(kind))


def _shape(df: DataFrame, vector_col: str) -> tuple[int, int] | None:
    """(commonest length, largest absolute grid value) of the usable vectors."""
    g = df.where(usable(F.col(vector_col)) & (F.size(vector_col) > 0)).select(grid(F.col(vector_col)).alias("g"))
    by = g.groupBy(F.size("g").alias("dims")).agg(F.count("*").alias("rows"), F.min(F.array_min("g")).alias("low"), F.max(F.array_max("g")).alias("high"))
    top = by.orderBy(F.desc("rows"), F.desc("dims")).limit(1).collect()
    return (top[0].dims, max(abs(top[0].low), abs(top[0].high))) if top else None


def _points(df: DataFrame, vector_col: str, dims: int, kind: str, *ids: Column) -> DataFrame:
    return df.where(usable(F.col(vector_col)) & (F.size(vector_col) == dims)).select(*ids, grid(F.col(vector_col), kind).alias("g"))


def _gramian(rows: DataFrame, n: int, dims: int) -> np.ndarray:
    """Sum of the rows' outer products; rows: (v), arrays of doubles."""
    vectors = rows.select(array_to_vector(F.col("v")).alias("v"))
    return RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v"), n, dims).computeGramianMatrix().toArray()


def _centred(g: Column, n: int, sums: list[int], reach: int) -> Column:
    """(n * g - sum) / n, the numerator exact: in longs where they hold it, else in decimals."""
    if 2 * n * max(reach, 1) < 1 << 62:
        return F.zip_with(g, F.lit(sums), lambda a, s: (a.cast("long") * n - s).cast("double") / n)
    wide = F.array(*[F.lit(str(s)).cast("decimal(38,0)") for s in sums])
    return F.zip_with(g, wide, lambda a, s: ((a.cast("decimal(19,0)") * F.lit(n).cast("decimal(19,0)")).cast("decimal(38,0)") - s).cast("double") / n)


def fit(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a table's distinct grid points; None where no row is usable."""
    shape = _shape(df, vector_col)
    if shape is None:
        return None
    dims, reach = shape
    kind = "smallint" if reach < 1 << 15 else "int" if reach < 1 << 31 else "bigint"
    points = cut(_points(df, vector_col, dims, kind).distinct())
    each = points.select(F.posexplode("g").alias("at", "c")).groupBy("at").agg(F.sum(F.col("c").cast("decimal(19,0)") if kind == "bigint" else F.col("c").cast("long")).alias("s"), F.count("*").alias("n"))
    held = sorted(each.collect())
    n, sums = held[0].n, [int(r.s) for r in held]
    v = _gramian(points.select(_centred(F.col("g"), n, sums, reach).alias("v")), n, dims) / n
    e, axes = np.linalg.eigh((v + v.T) / 2)
    e, axes = e[::-1], axes[:, ::-1][:, :components]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    model = Whitening(n, sums, reach, kind, e, axes, None)
    k = np.flatnonzero(model.sound)
    if not len(k):
        return model
    white = _apply(points.select(F.lit(0).alias("id"), "g"), model).select(F.array(*[F.col("whitened")[int(i)] for i in k]).alias("w"))
    mean = white.agg(*[F.avg(F.col("w")[i]) for i in range(len(k))]).first()
    cov = _gramian(white.select(F.zip_with("w", F.lit(list(mean)), lambda a, m: a - m).alias("v")), n, len(k)) / n
    return Whitening(n, sums, reach, kind, e, axes, float(np.abs(cov - np.eye(len(k))).max()))


def _apply(points: DataFrame, model: Whitening) -> DataFrame:
    """points: (id, g)."""
    n, dims, sound = model.n, len(model.sums), model.sound
    exact = 2 * n * max(model.reach, 1) < 1 << 62
    fits = exact and (2 * n * model.reach) ** 2 * dims < 1 << 63
    scaled = model.axes / np.sqrt(np.where(sound, model.eigenvalues[: len(sound)], 1.0))
    shared = points.sparkSession.sparkContext.broadcast((np.array(model.sums, np.int64 if exact else object), scaled))
    id_type = points.schema["id"].dataType.simpleString()

    def run(frames):
        sums, scale = shared.value
        for whole in frames:
            for lo in range(0, len(whole), 1024):
                part = whole.iloc[lo : lo + 1024]
                g = np.stack(part["g"].to_numpy()).astype(np.int64)
                d = (g if exact else g.astype(object)) * n - sums
                white = (d.astype(float) / n) @ scale
                if fits:
                    far = (d * d).sum(1)
                else:
                    far = [Decimal(x) if x < 10**38 else None for x in (d.astype(object) ** 2).sum(1)]
                rows = list(white) if sound.all() else [[x if ok else None for x, ok in zip(r, sound, strict=True)] for r in white.tolist()]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "deviation": far, "whitened": rows})

    out = points.mapInPandas(run, f"id {id_type}, deviation {'long' if fits else 'decimal(38,0)'}, whitened array<double>")
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def whiten(df: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, deviation, whitened) of every usable row: the sum of (n * x - S) ** 2, and a number for each component."""
    return _apply(_points(df, vector_col, len(model.sums), model.kind, F.col(id_col).alias("id")), model)


def op12_whitening(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    model = fit(df)
    shape = f"vec_id {df.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return spark.createDataFrame([], shape)
    rows = whiten(df, model).select(F.col("id").alias("vec_id"), F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*[F.lit(x).cast("double") for x in model.explained])
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"))
