"""Sessions and the ticket queue over streams of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shoots(events: DataFrame, key: str, time: str = "ts", gap: str = "90 minutes", late: str = "1 day") -> DataFrame:
    """key, started, ended and members of each session of a stream; a session is given out once no late event can reach it.

    `ended` is the last event's time. Events exactly `gap` apart are in one session. The state kept a key is one open window.
    """
    windows = events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("session"))
    return windows.agg(F.count(F.lit(1)).alias("members"), F.max(time).alias("ended")).select(key, F.col("session.start").alias("started"), "ended", "members")


def drain(spark: SparkSession, folder: str, checkpoint: str, run: Callable[[str], None]) -> int:
    """Work through the tickets that lie in a folder (one path a line, *.path or *.paths), each file once over all calls.

    Files are found by a file stream that stops when nothing new is left; `run` gets each path in the order of names.
    """
    done = 0

    def batch(rows: DataFrame, _: int) -> None:
        nonlocal done
        for row in rows.select("value", F.col("_metadata.file_name").alias("name")).orderBy("name", "value").toLocalIterator():
            run(row["value"])
            done += 1

    lines = spark.readStream.schema("value string").format("text").option("pathGlobFilter", "*.path*").load(folder).where("trim(value) <> ''")
    with_name = lines.select("value", "_metadata")
    query = with_name.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return done
