"""The kernels as columns and DataFrame functions. Frames travel in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.vision import kernels

FEATURES = ["brightness", "saturation", "difference", "edge_ratio", "hud_white_ratio", "hud_edge_ratio", "center_dark_ratio", "center_white_ratio", "center_edge_ratio"]


def frame_features(frames: DataFrame, width: int, height: int) -> DataFrame:
    """``path, n, t`` and the features of each frame; ``previous`` may be null."""

    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in FEATURES]))
    def measure(rgb: pd.Series, previous: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([kernels.frame_features(a, b, width, height) for a, b in zip(rgb, previous, strict=True)], columns=FEATURES)

    return frames.select("path", "n", "t", measure("rgb", "previous").alias("f")).select("path", "n", "t", "f.*")


def cropped(rgb: Column, width: int, height: int, x: int, y: int, w: int, h: int) -> Column:
    """A region of packed frames, packed alike."""

    @F.pandas_udf(T.BinaryType())
    def cut(raw: pd.Series) -> pd.Series:
        return raw.map(lambda r: np.frombuffer(r, np.uint8).reshape(height, width, 3)[y : y + h, x : x + w].tobytes())

    return cut(rgb)


def hue_histograms(rgb: Column, width: int, height: int) -> Column:
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def count(raw: pd.Series) -> pd.Series:
        return raw.map(lambda r: kernels.hue_histogram(kernels.picture(r, width, height)).tolist())

    return count(rgb)


def areas(rgb: Column, width: int, height: int, least: int) -> Column:
    """Connected bright areas of each frame by Otsu's threshold."""
    box = T.StructType([T.StructField(n, T.IntegerType()) for n in ("x", "y", "width", "height", "area")])

    @F.pandas_udf(T.ArrayType(box))
    def find(raw: pd.Series) -> pd.Series:
        def one(r: bytes) -> list[dict]:
            gray = kernels.picture(r, width, height).mean(axis=2).astype(np.uint8)
            return [c for c in kernels.components(gray > kernels.otsu(gray), eight=True) if c["area"] >= least]

        return raw.map(one)

    return find(rgb)
