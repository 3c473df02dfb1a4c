"""Folders of files as tables, through Spark's own readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepset.functions import scalars as S


def in_library(path: Column) -> Column:
    """Whether some folder of the path is a private library package, which is never touched."""
    return F.lower(path).rlike("\\.(" + "|".join(x[1:] for x in S.LIBRARY_EXTENSIONS) + ")(/|$)")


def _hidden(path: Column) -> Column:
    return path.rlike("(^|/)\\.[^/]*$")


def scan(spark: SparkSession, folder: str, recursive: bool = True, exclude: tuple[str, ...] = (), content: bool = False, extensions: tuple[str, ...] = (*S.IMAGE_EXTENSIONS, *S.RAW_EXTENSIONS)) -> DataFrame:
    """path, modified, bytes (and content) of the files with a known extension, hidden ones and library packages left out.

    The files' bytes are read only if content is asked for.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    path = F.col("path")
    kept = files.where(S.extension(path).isin(*extensions) & ~in_library(path) & ~_hidden(path))
    for name in exclude:
        kept = kept.where(~F.contains(path, F.lit(f"/{name.strip('/')}/")))
    columns = [path, F.unix_micros("modificationTime").alias("modified"), F.col("length").alias("bytes")]
    return kept.select(*columns, *(["content"] if content else []))


def listed(spark: SparkSession, list_path: str, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files named in a list of one path a line, lines that name none)."""
    names = spark.read.text(list_path).select(F.trim("value").alias("path")).where("path <> ''").distinct()
    return files.join(names, "path", "left_semi"), names.join(files, "path", "left_anti")


def with_companion(files: DataFrame, video: tuple[str, ...] = S.VIDEO_EXTENSIONS, videos: DataFrame | None = None) -> DataFrame:
    """files (path) with `motion`: whether a video of the same stem lies beside it, of videos (path) or of the files themselves."""
    stems = (files if videos is None else videos).where(S.extension(F.col("path")).isin(*video)).select(S.stem(F.col("path")).alias("stem")).distinct()
    joined = files.withColumn("stem", S.stem(F.col("path"))).join(stems.withColumn("motion", F.lit(True)), "stem", "left")
    return joined.select(*files.columns, F.coalesce("motion", F.lit(False)).alias("motion"))


def folder_size(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def settings(lines: list[str], environment: dict[str, str], prefix: str = "KEEPSET_") -> dict[str, str]:
    """key = value lines; what follows a # is a remark; an environment variable of the same name wins."""
    out = {}
    for line in lines:
        key, equals, value = line.partition("#")[0].partition("=")
        if equals and key.strip():
            out[key.strip()] = value.strip()
    return {k: environment.get(prefix + k.upper(), v) for k, v in out.items()}
