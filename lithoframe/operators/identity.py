"""Identity of a file's metadata, and Parquet side tables kept under it."""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lithoframe.sources.segy import SegyReader, open_layout

#: Trace headers that enter the identity; samples never do.
HEADERS = 64


def metadata_identity(path: str, mapping: dict[str, int] | None = None) -> str:
    """Hash of a file's reel header, size and up to HEADERS evenly spread trace headers, and of the mapping they are read with."""
    at = open_layout(path)
    h = hashlib.sha256(json.dumps([at.size, sorted((mapping or {}).items())]).encode())
    with open(path, "rb") as f:
        h.update(f.read(at.data_start))
    reader = SegyReader({"path": path, "view": "raw"})
    for k in np.unique(np.linspace(0, at.traces - 1, HEADERS).round().astype(int)) if at.traces else ():
        h.update(reader._heads(at, int(k), 1).tobytes())
    return h.hexdigest()


def file_sha256(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def raster_sha256(pixels: np.ndarray) -> str:
    """Hash of an image (height x width x 4, premultiplied 8-bit RGBA), whatever file holds it: its size and its pixels, row by row, behind a prefix of their kind."""
    h = hashlib.sha256(b"lithoframe.rgba8\0" + np.array(pixels.shape[1::-1], "<u8").tobytes())
    h.update(np.ascontiguousarray(pixels, np.uint8).tobytes())
    return h.hexdigest()


def cached_records(spark: SparkSession, path: str, cache: str, mapping: dict[str, int] | None = None) -> DataFrame:
    """A file's records, from a Parquet table under its identity; scanned and kept there if there is none, or if the file changed meanwhile."""
    key = metadata_identity(path, mapping)
    kept = os.path.join(cache, key)
    if not os.path.exists(os.path.join(kept, "_SUCCESS")):
        from lithoframe.sources.segy import register

        register(spark)
        reader = spark.read.format("segy").option("view", "records")
        if mapping:
            reader = reader.option("mapping", ",".join(f"{k}={v}" for k, v in mapping.items()))
        reader.load(path).write.mode("overwrite").parquet(kept)
        if metadata_identity(path, mapping) != key:
            raise RuntimeError(f"{path} changed while it was read")
    return spark.read.parquet(kept)
