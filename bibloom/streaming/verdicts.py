"""Verdict files as a stream with keyed state: the last verdict an index has, so that a drop costs its own rows.

A drop is a file of JSON lines. Its lines are read in order, malformed ones and unknown verdicts are left out, and the last
line of an index replaces what the state holds; a later drop replaces an earlier one. Files that arrive together count in
order of their names. Each run takes what is there (`availableNow`) and ends; the checkpoint folder carries the state on, so a
run that was lost is run again from where it stood. The table of last verdicts is read from the state, and
the changes of each drop are kept beside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from bibloom.sources.readers import VERDICTS

LINE = "index string, t string, verdict string, reason string, role string"
STATE = "t string, verdict string, reason string, role string"
CHANGE = f"index long, {STATE}, before string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# Kinds of works that a screener can name.
ROLES = ("review", "primary", "method", "theory")


def parsed(lines: DataFrame) -> DataFrame:
    """(file, line, index, t, verdict, reason, role) of the well-formed lines of (file, line, value); unknown roles are empty."""
    v = lines.select("file", "line", F.from_json("value", LINE).alias("v")).select("file", "line", "v.*")
    v = v.withColumn("index", F.when(F.col("index") == "true", 1).when(F.col("index") == "false", 0).otherwise(F.col("index").try_cast("long")))
    good = v.where(F.col("index").isNotNull() & F.col("verdict").isin(*VERDICTS))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return good.select("file", "line", "index", blank("t"), "verdict", blank("reason"), F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("").alias("role"))


def drops(spark: SparkSession, path: str) -> DataFrame:
    """The well-formed lines of files as they arrive. A file is one row first, so that its lines keep their order."""
    raw = spark.readStream.format("text").option("wholetext", True).load(path)
    lines = raw.select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return parsed(lines)


class LastVerdict(StatefulProcessor):
    """Keeps the last verdict of an index; gives a row when a drop changes it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best, place = None, None
        for pdf in rows:
            at = pdf.sort_values(["file", "line"]).iloc[-1]
            if place is None or (at["file"], at["line"]) > place:
                best, place = at, (at["file"], at["line"])
        if best is None:
            return
        now = tuple(str(best[c]) for c in ("t", "verdict", "reason", "role"))
        before = self.last.get() if self.last.exists() else None
        if before != now:
            self.last.update(now)
            yield pd.DataFrame([(key[0], *now, before[1] if before else "")], columns=["index", "t", "verdict", "reason", "role", "before"])

    def close(self) -> None:
        pass


def fold(spark: SparkSession, path: str, changes: str, checkpoint: str) -> None:
    """Takes all new drops into the state and writes what changed to `changes`/drop=N; safe to run again after a failure."""

    def put(batch: DataFrame, drop: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/drop={drop}")

    changed = drops(spark, path).groupBy("index").transformWithStateInPandas(LastVerdict(), outputStructType=CHANGE, outputMode="Update", timeMode="None")
    was = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # the only one that keeps such state
    try:
        changed.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if was is None else spark.conf.set(PROVIDER, was)


def latest(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(index, t, verdict, reason, role): the state after the last drop."""
    state = spark.read.format("statestore").option("stateVarName", "last").load(checkpoint)
    return state.select(F.col("key.index").alias("index"), "value.*")


def changed(spark: SparkSession, changes: str) -> DataFrame:
    """The changes of each drop, with its number."""
    return spark.read.schema(f"{CHANGE}, drop int").parquet(changes)
