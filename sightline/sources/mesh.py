"""Triangle mesh files: nine little-endian float32 per triangle, raw or as hex text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORNERS = [f"{p}{a}" for p in "abc" for a in "xyz"]
TRIANGLES = T.StructType(
    [
        T.StructField("map", T.StringType()),
        T.StructField("tri_id", T.LongType()),
        *[T.StructField(c, T.DoubleType()) for c in CORNERS],
    ]
)
BYTES = 36


def decode(data: bytes) -> bytes:
    """Raw bytes of a mesh file; hex text is recognised by its first 64 bytes."""
    head = data[:64].strip()
    if head and all(b in b"0123456789abcdefABCDEF \r\n\t" for b in head):
        return bytes.fromhex(data.decode("ascii"))
    return data


def read_triangles(spark: SparkSession, root: str) -> DataFrame:
    """All meshes below ``root`` as rows; a file's stem is its map.

    A mesh file is tens of megabytes and is decoded in one task; write the result as
    Parquet once and read that.
    """

    def parse(frames: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for frame in frames:
            for name, content in zip(frame["map"], frame["content"], strict=True):
                data = decode(bytes(content))
                rows = np.frombuffer(
                    data[: len(data) // BYTES * BYTES], dtype="<f4"
                ).reshape(-1, 9)
                out = pd.DataFrame(rows.astype("float64"), columns=CORNERS)
                out.insert(0, "tri_id", np.arange(len(out), dtype="int64"))
                out.insert(0, "map", name)
                yield out

    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.tri")
        .load(root)
        .select(F.regexp_extract("path", r"([^/]+)\.tri$", 1).alias("map"), "content")
    )
    return files.mapInPandas(parse, TRIANGLES)
