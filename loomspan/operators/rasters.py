"""Rasters of unequal size: resampling as two small matrices, and comparison after it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

LOBES = 3


@lru_cache(maxsize=256)
def weights(size: int, wanted: int) -> np.ndarray:
    """(wanted, size): how much each of `size` samples counts in each of `wanted`, by a windowed sinc of LOBES lobes.

    A wanted sample lies at its middle, on the scale of the given ones. Where samples get fewer the kernel is as much
    wider, so that it takes in all that falls to one. Rows add up to 1; what would lie beyond the edge does not count."""
    scale = size / wanted
    wide = max(scale, 1.0)
    x = (np.arange(size)[None, :] + 0.5 - (np.arange(wanted)[:, None] + 0.5) * scale) / wide
    w = np.where(np.abs(x) < LOBES, np.sinc(x) * np.sinc(x / LOBES), 0.0)
    return w / w.sum(1, keepdims=True)


def resample(picture: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """A picture at another height and width: rows and columns are weighted one after the other."""
    if picture.shape == shape:
        return picture
    return weights(picture.shape[0], shape[0]) @ picture @ weights(picture.shape[1], shape[1]).T


def compare_resized(pairs: DataFrame, tolerance: float) -> DataFrame:
    """(id, resized, similarity, mae) of pairs(id, a, a_width, b, b_width), pictures as arrays of rows: the share of pixels
    (%) that differ by no more than tolerance, and the mean difference, with b brought to a's size where it has another.
    Null where a picture is null, empty or not of whole rows."""

    def picture(values: np.ndarray | None, width: int | None) -> np.ndarray | None:
        if values is None or not width or not len(values) or len(values) % int(width):
            return None
        return np.asarray(values, np.float64).reshape(-1, int(width))

    def measured(a, a_width, b, b_width) -> tuple:
        x, y = picture(a, a_width), picture(b, b_width)
        if x is None or y is None:
            return None, None, None
        d = np.abs(x - resample(y, x.shape))
        return x.shape != y.shape, float((d <= tolerance).mean() * 100), float(d.mean())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [measured(*row) for row in zip(pdf["a"], pdf["a_width"].astype(object).where(pdf["a_width"].notna(), None), pdf["b"], pdf["b_width"].astype(object).where(pdf["b_width"].notna(), None))]
            yield pd.DataFrame({"id": pdf["id"], "resized": pd.Series([f[0] for f in found], dtype=object), "similarity": [f[1] for f in found], "mae": [f[2] for f in found]})

    return pairs.selectExpr("cast(id as bigint) as id", "a", "a_width", "b", "b_width").mapInPandas(run, "id long, resized boolean, similarity double, mae double")
