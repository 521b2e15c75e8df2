"""Raw float planes: little-endian 32-bit values of a raster, row by row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values from here on stand for missing ones in the files.
HUGE = 1e19


def decode_planes(files: DataFrame, slices: DataFrame, rows: int, cols: int, south_first: bool = True) -> DataFrame:
    """path, name, row, col, v of rasters within binary files; row 0 is the north.

    files: path and content, as ``spark.read.format("binaryFile")`` gives them;
    slices: path, name and the byte offset of each raster. A slice that ends beyond
    its file is an error. Infinite, huge and undefined values are missing. A raster
    is decoded whole in an Arrow batch, its cells come out as rows.
    """
    size = rows * cols * 4
    wanted = files.select("path", "content").join(slices.select("path", "name", "offset"), "path")
    body = F.when(F.length("content") >= F.col("offset") + size, F.expr(f"substring(content, cast(offset as int) + 1, {size})"))
    short = F.raise_error(F.concat(F.lit("short raster: "), "path", F.lit(" "), "name")).cast("binary")
    cut = wanted.select("path", "name", F.coalesce(body, short).alias("body"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row, col = (x.ravel() for x in np.indices((rows, cols), np.int32))
        for batch in batches:
            for path, name, raw in zip(batch["path"], batch["name"], batch["body"], strict=True):
                values = np.frombuffer(raw, "<f4").reshape(rows, cols)[:: -1 if south_first else 1].ravel().astype(float)
                yield pd.DataFrame({"path": path, "name": name, "row": row, "col": col, "v": np.where(np.isfinite(values) & (np.abs(values) < HUGE), values, np.nan)})

    out = cut.mapInPandas(run, "path string, name string, row int, col int, v double")
    return out.withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def encode_planes(cells: DataFrame, keys: tuple[str, ...], rows: int, cols: int, value: str = "v") -> DataFrame:
    """keys and ``body``: the raster of each group from its cells, south first; missing cells are 1e20."""

    def run(values: pd.DataFrame) -> pd.DataFrame:
        plane = np.full((rows, cols), 1e20, "<f4")
        plane[values["row"], values["col"]] = values[value].fillna(1e20)
        return pd.DataFrame([(*[values[k].iloc[0] for k in keys], plane[::-1].tobytes())], columns=[*keys, "body"])

    kinds = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in keys)
    return cells.select(*keys, "row", "col", value).groupBy(*keys).applyInPandas(run, f"{kinds}, body binary")
