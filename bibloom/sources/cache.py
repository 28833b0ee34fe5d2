"""Responses of indexes by key: an append-only log of answers and recorded misses, compacted into a base now and then.

The log is a folder of Parquet batches. A batch has a number, so an append that is run again replaces itself. The latest
entry of a key wins; a null payload is a recorded miss, which is an answer; a key without an entry was never asked. A
compaction writes the latest entries as a base; readers take the last whole base (its rows say how many there are, so that
a base cut short does not count) and the batches after it. Nothing is ever changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bibloom.functions import text as T
from bibloom.sources.shared import written

ROW = "key string, payload string, place long, total long"
BATCH = 50
#: Keys that are ranked in one group, about.
GROUP = 10_000


def key_of(kind: str, *parts: Column) -> Column:
    """The key of a request: `crossref:doi`, `datacite:doi` (bare DOI), `arxiv` (id as asked), `crossref:search`, `openalex:search` (comparable text)."""
    text = F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])
    asked = T.normalize_title(text) if kind.endswith(":search") else F.trim(text) if kind == "arxiv" else F.lower(F.trim(text))
    return F.concat(F.lit(f"{kind}:"), asked)


class ResponseLog:
    """A response log in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _stored(self) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(f"{ROW}, kind string, batch int").option("basePath", self.root).parquet(self.root)
        except AnalysisException as e:  # nothing was appended yet
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def _numbers(self) -> list[tuple[str, int, int, int]]:
        """(kind, batch, rows, total told by the rows) of what is stored."""
        held = self._stored()
        return [] if held is None else [tuple(r) for r in held.groupBy("kind", "batch").agg(F.count("*"), F.max("total")).collect()]

    def _base(self, numbers: list[tuple[str, int, int, int]]) -> int:
        return max((batch for kind, batch, n, total in numbers if kind == "base" and n == total), default=-1)

    def append(self, entries: DataFrame, batch: int | None = None) -> int:
        """Adds entries (key, payload), in their order of column `place` if there is one; returns the number of the batch."""
        if batch is None:
            batch = max((b for _, b, *_ in self._numbers()), default=-1) + 1
        place = F.col("place").cast("long") if "place" in entries.columns else F.lit(0).cast("long")
        rows = entries.select("key", "payload", place.alias("place"), F.lit(0).cast("long").alias("total"))
        rows.write.mode("overwrite").parquet(f"{self.root}/kind=entries/batch={batch}")
        return batch

    def entries(self) -> DataFrame:
        """(key, payload): the latest entry of each key."""
        held = self._stored()
        if held is None:
            return self.spark.createDataFrame([], "key string, payload string")
        base = self._base(self._numbers())
        live = held.where(((F.col("kind") == "base") & (F.col("batch") == base)) | ((F.col("kind") == "entries") & (F.col("batch") > base)))
        last = live.groupBy("key").agg(F.max_by(F.struct("payload"), F.struct("batch", "place", "payload")).alias("r"))
        return last.select("key", "r.payload")

    def compact(self) -> None:
        """Writes the latest entries as a base; the batches it holds are not read again."""
        upto = max((b for _, b, *_ in self._numbers()), default=-1)
        if upto < 0:
            return
        rows = written(self.entries(), "base")
        rows.select("key", "payload", F.lit(0).cast("long").alias("place"), F.lit(rows.count()).cast("long").alias("total")).write.mode("overwrite").parquet(f"{self.root}/kind=base/batch={upto}")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """keys (with column key) with known and payload: known without payload is a recorded miss."""
        own = self.entries().withColumn("known", F.lit(True))
        return keys.join(own, "key", "left").withColumn("known", F.coalesce("known", F.lit(False)))

    def unknown(self, keys: DataFrame) -> DataFrame:
        """(key): the distinct keys that were never asked."""
        return keys.select("key").where("key is not null").distinct().join(self.entries().select("key"), "key", "left_anti")

    def absorb(self, answers: DataFrame) -> int:
        """Adds what a request for many keys brought (key, payload). Keys that it did not bring stay unasked: one bad answer must not make works absent."""
        hits = written(answers.where("payload is not null"), "hits")
        self.append(hits)
        return hits.count()


def request_batches(keys: DataFrame, size: int = BATCH) -> DataFrame:
    """(batch, keys): distinct keys in requests of exactly `size`, the last one of what is left.

    Keys are numbered inside groups dealt by hash; the groups' sizes, a row a group, give each its first number.
    """
    own = written(keys.select("key").distinct(), "keys")
    groups = max(1, -(-own.count() // GROUP))
    dealt = own.withColumn("_g", F.pmod(F.xxhash64("key"), F.lit(groups)))
    before = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)  # a row a group
    base = dealt.groupBy("_g").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    number = F.col("first") + F.row_number().over(Window.partitionBy("_g").orderBy("key")) - 1
    ranked = dealt.join(base.select("_g", "first"), "_g").withColumn("batch", F.floor(number / size))
    return ranked.groupBy("batch").agg(F.sort_array(F.collect_list("key")).alias("keys"))


def prefetched(log: ResponseLog, keys: DataFrame, answer, size: int = BATCH) -> int:
    """Asks for the unknown keys in batches and stores what came; how many did. answer: (batch, keys) rows to (key, payload) rows."""
    return log.absorb(answer(request_batches(log.unknown(keys), size)))
