"""Compact payloads of quantised planes, one for each frame.

Layout, fixed by its readers: the magic ``MVHG``, the header's length as an
unsigned 32-bit little-endian integer, a JSON header (schemaVersion, rows, cols,
variables with scale, offset, missing, byteOffset and length), then the planes
as little-endian 16-bit integers, all gzipped.  A JSON form holds the planes as
base64 instead.
"""

from __future__ import annotations

import base64
import gzip
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbostrat.functions.units import MISSING_CODE, quantise

MAGIC = b"MVHG"
SCHEMA_VERSION = 1


def pack(rows: int, cols: int, planes: dict[str, tuple[float, np.ndarray]], binary: bool = True) -> bytes:
    """planes: name -> (scale, codes)."""
    meta, body = {}, b""
    for name, (scale, codes) in planes.items():
        raw = np.asarray(codes, "<i2").tobytes()
        meta[name] = {"scale": scale, "offset": 0, "missing": MISSING_CODE}
        meta[name] |= {"byteOffset": len(body), "length": len(raw) // 2} if binary else {"data": base64.b64encode(raw).decode()}
        body += raw
    header = json.dumps({"schemaVersion": SCHEMA_VERSION, "rows": rows, "cols": cols, "variables": meta}).encode()
    return gzip.compress(MAGIC + len(header).to_bytes(4, "little") + header + body if binary else header, 1, mtime=0)


def unpack(payload: bytes) -> tuple[int, int, dict[str, tuple[float, float, int, np.ndarray]]]:
    """(rows, cols, name -> (scale, offset, missing, codes)) of either form."""
    raw = gzip.decompress(payload)
    start = 8 + int.from_bytes(raw[4:8], "little") if raw[:4] == MAGIC else 0
    header = json.loads(raw[8:start] if start else raw)
    planes = {}
    for name, m in header.get("variables", {}).items():
        body = raw[start + m["byteOffset"] : start + m["byteOffset"] + 2 * m["length"]] if start else base64.b64decode(m.get("data", ""))
        planes[name] = (m.get("scale", 1), m.get("offset", 0), m.get("missing", MISSING_CODE), np.frombuffer(body, "<i2"))
    return header.get("rows", 0), header.get("cols", 0), planes


def encode_frames(cells: DataFrame, rows: int, cols: int, keys: tuple[str, ...], binary: bool = True) -> DataFrame:
    """keys, payload of cells (keys, variable, scale, row, col, value).

    A frame's raster has a fixed size, which bounds its group. Variables without
    any known value are left out.
    """
    kinds = ", ".join(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys)
    coded = cells.select(*keys, "variable", "scale", (F.col("row") * cols + F.col("col")).alias("at"), quantise(F.col("value"), F.col("scale")).alias("code"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        planes = {}
        for name, part in sorted(pdf.groupby("variable"), key=lambda x: x[0]):
            codes = np.full(rows * cols, MISSING_CODE, np.int16)
            codes[part["at"].to_numpy()] = part["code"].to_numpy()
            if (codes != MISSING_CODE).any():
                planes[name] = (float(part["scale"].iloc[0]), codes)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "payload": [pack(rows, cols, planes, binary)]})

    return coded.groupBy(*keys).applyInPandas(one, f"{kinds}, payload binary")


def decode_frames(frames: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, variable, row, col, value of payloads; missing cells are null."""
    kinds = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                rows, cols, planes = unpack(row["payload"])
                for name, (scale, offset, missing, codes) in planes.items():
                    at = np.arange(len(codes))
                    value = np.where(codes == missing, np.nan, codes * scale + offset)
                    yield pd.DataFrame({**{k: row[k] for k in keys}, "variable": name, "row": at // cols, "col": at % cols, "value": value})

    out = frames.select(*keys, "payload").mapInPandas(run, f"{kinds}, variable string, row int, col int, value double")
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def merge_frames(existing: DataFrame, incoming: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Decoded cells of both, variable by variable; the incoming ones win."""
    mine = [*keys, "variable"]
    kept = existing.join(incoming.select(*mine).distinct(), mine, "left_anti")
    return kept.unionByName(incoming)
