"""Model inference as an operator over tiles.

A predictor is ``(tiles [n, 1, s, s], latent [n, 8]) -> [n, 1, s, s]``.  Base blocks, not
pixels, are sent to the windows that need them, so a pixel crosses the network once for each
window as a few bytes of an array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import normals
from . import raster

Predictor = Callable[[np.ndarray, np.ndarray], np.ndarray]
LATENT = 8


class Identity:
    """Gives tiles back."""

    def __call__(self, tiles: np.ndarray, latent: np.ndarray) -> np.ndarray:
        return tiles


class Affine:
    """scale * tiles + shift."""

    def __init__(self, scale: float, shift: float):
        self.scale, self.shift = scale, shift

    def __call__(self, tiles: np.ndarray, latent: np.ndarray) -> np.ndarray:
        return tiles * np.float32(self.scale) + np.float32(self.shift)


def predict(tiles: DataFrame, predictors: Sequence[Predictor], outputs: Sequence[str], batch: int = 16, data: str = "data", latent: str = "latent") -> DataFrame:
    """Add the outputs of chained predictors: each takes the one before; all share a tile's latent vector.

    Weights go out once, as a broadcast; tiles come in Arrow batches.
    """
    known = tiles.sparkSession.sparkContext.broadcast(list(predictors))
    side_of = lambda n: int(round(n**0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, batch):
                part = whole.slice(i, batch)
                x = np.stack([t.values.to_numpy(zero_copy_only=False) for t in part.column(part.schema.get_field_index(data))]).astype(np.float32)
                side = side_of(x.shape[1])
                x = x.reshape(-1, 1, side, side)
                z = np.stack([t.values.to_numpy(zero_copy_only=False) for t in part.column(part.schema.get_field_index(latent))]).astype(np.float32)
                made = []
                for p in known.value:
                    x = p(x, z)
                    made.append(pa.array(list(x.reshape(len(x), -1).astype(np.float32)), pa.list_(pa.float32())))
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *outputs])

    schema = tiles.schema
    for name in outputs:
        schema = T.StructType([*schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))])
    return tiles.mapInArrow(run, schema)


def windows_of(px: DataFrame, height: int, width: int, size: int, stride: int, value: str = "value") -> DataFrame:
    """Tiles (win_row, win_col, size, data) of all overlapping windows of a raster, padded by reflection.

    Pixels are first packed into stride x stride blocks; each block goes whole to its windows.
    """
    if size % stride:
        raise ValueError("windows must be a whole number of strides")
    padded = raster.pad_reflect(px.select("row", "col", value), height, width, size, stride)
    h, w, k = raster.padded_size(height, size, stride), raster.padded_size(width, size, stride), size // stride
    at = (F.col("row") % stride) * stride + F.col("col") % stride
    packed = padded.groupBy(F.floor(F.col("row") / stride).cast("int").alias("br"), F.floor(F.col("col") / stride).cast("int").alias("bc")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(at.alias("i"), F.col(value).cast("float").alias("v")))), lambda p: p["v"]).alias("block")
    )

    def first(b: str, n: int):
        return F.explode(F.sequence(F.greatest(F.lit(0), F.col(b) - (k - 1)), F.least(F.lit((n - size) // stride), F.col(b))))

    sent = packed.withColumn("wr", first("br", h)).withColumn("wc", first("bc", w))
    # A window's k * k blocks, in order; its rows are strips of the blocks' rows.
    place = (F.col("br") - F.col("wr")) * k + F.col("bc") - F.col("wc")
    held = sent.groupBy("wr", "wc").agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("i"), F.col("block").alias("b")))), lambda p: p["b"]).alias("blocks"))
    row = lambda r: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.slice(F.element_at("blocks", (F.floor(r / stride) * k + c + 1).cast("int")), ((r % stride) * stride + 1).cast("int"), stride)))
    data = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), row))
    return held.select((F.col("wr") * stride).alias("win_row"), (F.col("wc") * stride).alias("win_col"), F.lit(size).alias("size"), data.alias("data"))


def infer(
    px: DataFrame,
    height: int,
    width: int,
    predictors: Sequence[Predictor],
    outputs: Sequence[str],
    size: int = 256,
    stride: int = 64,
    seed: int = 0,
    value: str = "value",
    decode: dict[str, Callable[[Column], Column]] | None = None,
    latent: Column | None = None,
) -> DataFrame:
    """(row, col, outputs): overlap-averaged sliding-window predictions of a raster.

    ``decode`` turns an output into the quantity whose windows are averaged: a mean of decoded
    values is not the decoded mean unless the code is linear.  ``latent`` is an array of LATENT
    numbers from win_row and win_col; without it, normal numbers by the window and the seed.
    """
    decode = decode or {}
    drawn = normals(F.concat_ws(",", "win_row", "win_col"), seed, LATENT) if latent is None else latent
    tiles = windows_of(px, height, width, size, stride, value).withColumn("latent", drawn.cast("array<float>"))
    made = predict(tiles, predictors, outputs)
    zipped = made.select("win_row", "win_col", F.posexplode(F.arrays_zip(*outputs)).alias("_i", "_v"))
    at = [(F.col("win_row") + F.floor(F.col("_i") / size)).cast("int").alias("row"), (F.col("win_col") + F.col("_i") % size).cast("int").alias("col")]
    return raster.overlap_average(zipped.select(*at, *[decode.get(o, lambda c: c)(F.col("_v")[o].cast("double")).alias(o) for o in outputs]), height, width, outputs)
