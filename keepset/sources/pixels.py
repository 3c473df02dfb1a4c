"""Decoded pictures: gray sketches, focus and a key of the pixels. Spark's own image source decodes them on the executors.

It reads what the JVM's decoders know (JPEG, PNG, BMP, GIF); other files are left out. Rows hold whole pictures, so batches are
small; what leaves is a sketch and a few numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepset.operators import signal
from keepset.operators.sketches import HEIGHT, WIDTH
from keepset.runtime import ship, tidy

#: Shares of blue, green and red in gray.
GRAY = np.array([0.114, 0.587, 0.299], dtype=np.float32)
LOOKS = "path string, height int, width int, sketch binary, sharp double, pixels_key string"


def pictures(spark: SparkSession, folder: str) -> DataFrame:
    """path, height, width, channels and data (rows of blue, green, red) of the pictures that can be decoded."""
    read = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(folder)
    path = F.regexp_replace(F.col("image.origin"), "^file:/+", "file:/")  # as the file source writes it
    return read.select(path.alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def gray(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return pixels[..., 0].astype(np.float32) if channels == 1 else pixels[..., :3].astype(np.float32) @ GRAY


def turned(picture: np.ndarray, orientation: int | None) -> np.ndarray:
    """Upright, by the orientation flag: 3 half a turn, 6 and 8 quarter turns, 2, 4, 5 and 7 with a mirror."""
    flips = {2: lambda p: p[:, ::-1], 3: lambda p: p[::-1, ::-1], 4: lambda p: p[::-1], 5: lambda p: p.T, 6: lambda p: p.T[:, ::-1], 7: lambda p: p.T[::-1, ::-1], 8: lambda p: p.T[::-1]}
    return flips[orientation](picture) if orientation in flips else picture


def sketched(picture: np.ndarray) -> np.ndarray:
    """The picture's mean over each cell of a grid of HEIGHT by WIDTH; small pictures repeat rows and columns."""
    for axis, n in ((0, HEIGHT), (1, WIDTH)):
        size = picture.shape[axis]
        if size >= n:
            edges = np.arange(n) * size // n
            picture = np.add.reduceat(picture, edges, axis=axis) / np.expand_dims(np.diff(np.append(edges, size)), 1 - axis).astype(np.float32)
        else:
            picture = np.take(picture, np.arange(n) * size // n, axis=axis)
    return np.clip(np.rint(picture), 0, 255).astype(np.uint8)


def focus(picture: np.ndarray) -> float:
    """The mean of the TOP largest variances of the Laplacian in the tiles of a GRID by GRID grid, each weighted by its place.

    Second differences along both axes; a tile's variance comes from its sums of values and squares.
    """
    laplacian = np.diff(picture, 2, axis=0)[:, 1:-1].astype(np.float64) + np.diff(picture, 2, axis=1)[1:-1]
    steps = [max(n // signal.GRID, 1) for n in laplacian.shape]
    whole = laplacian[: steps[0] * signal.GRID, : steps[1] * signal.GRID]
    sums = lambda x: np.add.reduceat(np.add.reduceat(x, np.arange(signal.GRID) * steps[0], axis=0), np.arange(signal.GRID) * steps[1], axis=1) / (steps[0] * steps[1])
    variance = sums(whole * whole) - sums(whole) ** 2
    weighted = variance.reshape(-1) * np.array(signal.gaussian_weights())
    return float(np.partition(weighted, -signal.TOP)[-signal.TOP :].mean())


def looks(read: DataFrame) -> DataFrame:
    """LOOKS of pictures(); a column `orientation`, if there is one, is applied to sketches."""
    ship(read.sparkSession)
    names = [x.split()[0] for x in LOOKS.split(", ")]
    oriented = "orientation" in read.columns

    def looked(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.string())
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                picture = gray(row["data"], row["height"], row["width"], row["channels"])
                sharp = focus(picture) if min(picture.shape) >= signal.GRID + 2 else 0.0
                key = hashlib.sha256(f"{row['height']}x{row['width']}x{row['channels']}".encode() + row["data"]).hexdigest()
                values = (row["path"], row["height"], row["width"], sketched(turned(picture, row["orientation"] if oriented else None)).tobytes(), sharp, key)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names)

    columns = ["path", "height", "width", "channels", "data"] + (["orientation"] if oriented else [])
    return read.select(*columns).mapInArrow(tidy(looked), LOOKS)

