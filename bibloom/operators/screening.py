"""Screening hand-off: batches for a reader, verdicts matched back to works by place and checksum, counts, queue."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from bibloom.functions import text as T
from bibloom.functions.numeric import one_digit
from bibloom.sources.shared import written


def batches(works: DataFrame, size: int = 25, chars: int = 600, corpus: DataFrame | None = None) -> DataFrame:
    """(batch, work_id, position, title, check, year, abstract): works dealt by corpus order.

    The place of a work in its batch needs a global order; positions are counted per range first, so that no window
    takes all rows. What a batch shows is cut from the works and written once; ranges, counts and places read that.
    corpus: the works have to be of it, else reading the batches fails.
    """
    of = works if corpus is None else held_by(works, corpus)
    shown = of.select("work_id", "position", "title", T.checksum(F.col("title")).alias("check"), "year", F.substring(F.trim("abstract"), 1, chars).alias("abstract"), F.floor(F.col("position") / 10_000).alias("_range"))
    spread = written(shown, "batches")
    before = spread.groupBy("_range").agg(F.count("*").alias("n"))
    total = before.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = spread.join(total.select("_range", "base"), "_range").withColumn("_k", F.row_number().over(Window.partitionBy("_range").orderBy("position")) - 1 + F.col("base"))
    return placed.select(F.floor(F.col("_k") / size).alias("batch"), "work_id", "position", "title", "check", "year", "abstract")


def batch_files(dealt: DataFrame) -> DataFrame:
    """(batch, payload): one JSON object for each batch, at most `size` works, in order."""
    work = F.struct("position", F.col("title").alias("t"), F.col("check").alias("c"), F.nullif(F.col("year"), F.lit("")).alias("y"), F.nullif(F.col("abstract"), F.lit("")).alias("a"))
    return dealt.groupBy("batch").agg(F.sort_array(F.collect_list(work)).alias("works")).select("batch", F.to_json(F.struct("batch", F.transform("works", lambda w: F.struct(w["position"].alias("i"), w["t"].alias("t"), w["c"].alias("c"), w["y"].alias("y"), w["a"].alias("a"))).alias("works"))).alias("payload"))


def foreign(subset: DataFrame, works: DataFrame) -> DataFrame:
    """Works of a subset that the corpus does not hold; a batch of them is an error."""
    return subset.join(works.select("work_id"), "work_id", "left_anti")


def held_by(subset: DataFrame, works: DataFrame) -> DataFrame:
    """subset as it is, but reading it fails if it has a work that the corpus does not hold: its verdicts could not be applied back.

    The check is part of the plan, row by row; nothing is counted beforehand.
    """
    own = works.select("work_id", F.lit(True).alias("_held")).distinct()
    told = F.concat(F.lit("work "), F.coalesce(F.col("work_id").cast("string"), F.lit("without id")), F.lit(" is not in the corpus; its verdict could not be applied back"))
    return subset.join(own, "work_id", "left").where(F.coalesce(F.col("_held"), F.raise_error(told).cast("boolean"))).select(*subset.columns)


@F.pandas_udf(BooleanType())
def echo_matches(echo: pd.Series, title: pd.Series) -> pd.Series:
    """Each echoed word resembles the title's word at its place by 0.7; an empty echo matches."""
    import re

    def one(e: str, t: str) -> bool:
        probe, target = ([w for w in re.split(r"\W+", (x or "").lower()) if w] for x in (e, t))
        return len(probe) <= len(target) and all(T.ratio(p, q) >= 0.7 for p, q in zip(probe, target))

    return pd.Series([one(e, t) for e, t in zip(echo, title)], dtype=bool)


def echo_matches_exactly(echo, title):
    """The same test with equal words, in built-in functions."""
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\W+"), lambda w: w != "")
    return F.slice(words(title), 1, F.greatest(F.size(words(echo)), F.lit(1))) == F.when(F.size(words(echo)) == 0, F.slice(words(title), 1, 1)).otherwise(words(echo))


def align(works: DataFrame, verdicts: DataFrame, matches=echo_matches, keep_rules: bool = True) -> DataFrame:
    """works with new_screen, new_reason, new_role and outcome (applied, realigned, unverified, misaligned, by_rule, unscreened).

    A verdict goes to the work at its index if the echo matches there; else to the only work with its checksum; else
    to none. A verdict that was moved to a work replaces the one that lies there.
    """
    w = works.withColumn("check", T.checksum(F.col("title")))
    unique = w.groupBy("check").agg(F.count("*").alias("n"), F.min("position").alias("to")).where("n = 1").select("check", "to")
    v = verdicts.join(w.select(F.col("position").alias("index"), F.col("title").alias("at_title")), "index", "left")
    v = v.withColumn("blank", F.coalesce("t", F.lit("")) == "").withColumn("fits", F.when(F.col("blank"), True).otherwise(matches(F.coalesce("t", F.lit("")), F.coalesce("at_title", F.lit("")))))
    v = v.withColumn("echo", F.array_join(F.filter(F.split(F.lower("t"), r"\s+"), lambda x: x != ""), " "))
    moved = v.where(~F.col("fits")).join(unique, v["echo"] == unique["check"]).groupBy("to").agg(F.max_by(F.struct("t", "verdict", "reason", "role"), "index").alias("m"), F.max("index").alias("from_index"))
    stays = v.join(moved.select(F.col("from_index").alias("index"), F.lit(True).alias("gone")), "index", "left").where(F.col("gone").isNull()).select(F.col("index").alias("position"), F.struct("t", "verdict", "reason", "role").alias("s"), "fits", "blank")
    out = w.join(stays, "position", "left").join(moved.select(F.col("to").alias("position"), "m"), "position", "left")
    rule = F.lit(keep_rules) & (F.coalesce("screen", F.lit("")) != "") & F.startswith(F.coalesce("screen_reason", F.lit("")), F.lit("rule:"))
    got = F.when(F.col("m").isNotNull(), F.col("m")).when(F.col("fits"), F.col("s"))
    out = out.withColumn("got", got).withColumn("outcome", F.when(F.col("m").isNotNull(), "realigned").when(F.col("fits") & F.col("blank"), "unverified").when(F.col("fits"), "applied").when(rule, "by_rule").when(F.col("s").isNotNull(), "misaligned").otherwise("unscreened"))
    keep = lambda f, old: F.when(F.col("got").isNotNull(), F.col(f"got.{f}")).when(rule, F.col(old)).otherwise("")
    return out.select(*works.columns, keep("verdict", "screen").alias("new_screen"), keep("reason", "screen_reason").alias("new_reason"), F.coalesce(keep("role", "role"), F.lit("")).alias("new_role"), "outcome", (F.col("s").isNotNull() & F.col("m").isNull() & ~F.coalesce("fits", F.lit(False))).alias("refused"))


def verdict_counts(aligned: DataFrame) -> DataFrame:
    """One row of counts, by conditional aggregation."""
    is_ = lambda v: F.count_if(F.col("new_screen") == v)
    out = lambda v: F.count_if(F.col("outcome") == v)
    return aligned.agg(is_("include").alias("include"), is_("exclude").alias("exclude"), is_("unsure").alias("unsure"), is_("").alias("unscreened"), out("by_rule").alias("by_rule"), F.count_if("refused").alias("misaligned"), out("unverified").alias("unverified"), out("realigned").alias("realigned"), F.count_if(F.col("new_role") != "").alias("roled"))


def review_queue(works: DataFrame) -> DataFrame:
    """Works that a person has to look at."""
    return works.where(F.coalesce("screen", F.lit("")).isin("", "unsure"))


def screened_in(works: DataFrame) -> DataFrame:
    return works.where("screen = 'include'")


def extraction_tasks(works: DataFrame, fields: list[str], cite_keys: DataFrame | None = None, instructions: str = "") -> DataFrame:
    """(work_id, task): what an extractor gets for a screened-in and verified work.

    While no work has a verdict but those that rules excluded, it is all verified works. cite_keys: (work_id, cite_key)
    of refs.bib; a work without one is `work` and its position in the corpus (its work_id where works have none), three
    digits at least. Works without a column oa_pdf_url have no such link.
    """
    by_hand = (F.coalesce("screen", F.lit("")) != "") & ~F.startswith(F.coalesce("screen_reason", F.lit("")), F.lit("rule:"))
    some = works.agg(F.coalesce(F.bool_or(by_hand), F.lit(False)).alias("some"))  # one row
    picked = works.join(F.broadcast(some)).where((F.col("validation") == "verified") & (~F.col("some") | (F.col("screen") == "include")))
    picked = picked.withColumn("cite_key", F.lit(None).cast("string")) if cite_keys is None else picked.join(cite_keys, "work_id", "left")
    place = F.col("position" if "position" in works.columns else "work_id").cast("string")
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in works.columns else F.lit("")
    task = F.struct(
        F.lit(instructions).alias("instructions"), F.coalesce(F.nullif("cite_key", F.lit("")), F.concat(F.lit("work"), F.lpad(place, F.greatest(F.lit(3), F.length(place)), F.lit("0")))).alias("cite_key"),
        "title", "doi", "arxiv_id", "year", text("oa_pdf_url").alias("pdf_url"), T.arxiv_pdf_url(F.col("arxiv_id")).alias("arxiv_pdf_url"),
        ((text("oa_pdf_url") != "") | (text("arxiv_id") != "")).alias("has_open_access_pdf"), text("abstract").alias("abstract"), F.array(*map(F.lit, fields)).alias("schema"),
    )
    return picked.select("work_id", F.to_json(task, {"ignoreNullFields": "false"}).alias("task"))


def gold_recall(gold: DataFrame, works: DataFrame) -> DataFrame:
    """gold with found, screen and validation by cleaned DOI; of works that share one the last counts.

    A found work without a verdict is `unscreened`; a paper not found has blanks.
    """
    own = works.select(F.nullif("doi", F.lit("")).alias("d"), "screen", "validation", "position").where("d is not null").groupBy("d").agg(F.max_by(F.struct("screen", "validation"), "position").alias("w"))
    screen = F.when(F.col("w").isNotNull(), F.coalesce(F.nullif("w.screen", F.lit("")), F.lit("unscreened"))).otherwise("")
    return gold.withColumn("d", T.clean_doi(F.col("doi"))).join(own, "d", "left").select(*gold.columns, F.col("w").isNotNull().alias("found"), screen.alias("screen"), F.coalesce("w.validation", F.lit("")).alias("validation"))


SCREENED_OUT = ("exclude", "unsure")


def gold_summary(recalled: DataFrame) -> DataFrame:
    """One row from gold_recall's: total, found, recall_pct (one digit, 0 without gold papers) and how many were found but screened out."""
    counts = recalled.agg(F.count("*").alias("total"), F.count_if("found").alias("found"), F.count_if(F.col("found") & F.col("screen").isin(*SCREENED_OUT)).alias("found_but_screened_out"))
    return counts.withColumn("recall_pct", F.when(F.col("total") > 0, one_digit(F.coalesce(F.try_divide(100 * F.col("found"), F.col("total")), F.lit(0.0)))).otherwise(0.0))


def gold_missed(recalled: DataFrame) -> DataFrame:
    """(key, failure) of gold papers that the corpus lacks (`missed`) or screened out (`screened_out`)."""
    failure = F.when(~F.col("found"), "missed").when(F.col("screen").isin(*SCREENED_OUT), "screened_out")
    key = F.coalesce("key", T.clean_doi(F.col("doi"))) if "key" in recalled.columns else T.clean_doi(F.col("doi"))
    return recalled.select(key.alias("key"), failure.alias("failure")).where("failure is not null")


#: Items compared in one pass over the works; more take more passes.
ITEMS = 4096


class NearestTitles:
    """The best work of each item so far, by ratio, then by position; works come in batches.

    Bounds come first. A ratio is at most twice the letters that two titles share, and at most twice their longest common
    subsequence, over the sum of lengths. The works of a batch are taken in falling order of the letter bound until it
    falls below the best ratio found; the subsequence decides whether the ratio itself is worked out.
    """

    BINS = 64

    def __init__(self, titles: list[str]):
        self.titles = titles
        self.counts = self._counts(titles)
        self.sizes = np.array([len(t) for t in titles])
        self.best: list[tuple[float, float, int | None]] = [(0.0, 0.0, None)] * len(titles)
        self.masks = []
        for t in titles:
            mask: dict[str, int] = {}
            for i, c in enumerate(t):
                mask[c] = mask.get(c, 0) | 1 << i
            self.masks.append(mask)

    def _counts(self, titles: list[str]) -> np.ndarray:
        out = np.zeros((len(titles), self.BINS), np.int32)
        for row, t in zip(out, titles):
            np.add.at(row, np.fromiter((ord(c) % self.BINS for c in t), np.int64, len(t)), 1)
        return out

    def _common(self, k: int, other: str) -> int:
        """Length of the longest common subsequence, one bit a letter of the item."""
        mask, size = self.masks[k], len(self.titles[k])
        ones = (1 << size) - 1
        held = ones
        for c in other:
            met = held & mask.get(c, 0)
            held = ((held + met) | (held - met)) & ones
        return size - held.bit_count()

    def meet(self, titles: list[str], positions: list[int]) -> None:
        counts, sizes, where = self._counts(titles), np.array([len(t) for t in titles]), np.array(positions)
        for k, title in enumerate(self.titles):
            total = sizes + self.sizes[k]
            bound = 2.0 * np.minimum(counts, self.counts[k]).sum(axis=1) / np.maximum(total, 1)
            best, at, found = self.best[k]
            for i in np.lexsort((where, -bound)):
                if bound[i] < best or bound[i] == 0:
                    break
                if 2.0 * self._common(k, titles[i]) / total[i] < best:
                    continue
                r = T.ratio(title, titles[i])
                if r > best or (r == best and r > 0 and where[i] < at):
                    best, at, found = r, int(where[i]), int(where[i])
            self.best[k] = (best, at, found)


def known_items(items: DataFrame, works: DataFrame, least: float = 0.8) -> DataFrame:
    """items (item_id, title) with the work of the nearest title (the earlier one on ties), its ratio and whether it is `least`.

    The nearest work is told below `least` too; a work that shares no letter is none (ratio 0). Items are the query set:
    blocks of about ITEMS of them meet every work, in tasks over the works that each keep one best work an item.
    """
    n = items.count()
    passes = max(1, -(-n // ITEMS))
    own = works.where(F.coalesce("title", F.lit("")) != "").select(F.col("position").cast("long").alias("position"), F.lower("title").alias("title"))
    out = None
    for k in range(passes):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).select("item_id", F.lower(F.coalesce("title", F.lit(""))).alias("title")).collect()  # about ITEMS rows
        titles = sorted({r["title"] for r in block if r["title"]})

        def run(batches: Iterator[pa.RecordBatch], titles: list[str] = titles) -> Iterator[pa.RecordBatch]:
            near = NearestTitles(titles)
            for batch in batches:
                near.meet(batch.column("title").to_pylist(), batch.column("position").to_pylist())
            best = [(t, r, at) for t, (r, _, at) in zip(titles, near.best) if at is not None]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, *_ in best], pa.string()), pa.array([r for _, r, _ in best], pa.float64()), pa.array([at for *_, at in best], pa.int64())], names=["wanted", "ratio", "position"])

        found = own.mapInArrow(run, "wanted string, ratio double, position long").groupBy("wanted").agg(F.max(F.struct("ratio", (-F.col("position")).alias("minus"))).alias("b"))
        found = found.select("wanted", "b.ratio", (-F.col("b.minus")).alias("position"))
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        part = mine.withColumn("wanted", F.lower("title")).join(found, "wanted", "left").drop("wanted")
        out = part if out is None else out.unionByName(part)
    named = works.select(F.col("position").cast("long").alias("position"), "work_id", F.col("title").alias("best_match"))
    ratio = F.coalesce("ratio", F.lit(0.0))
    return out.join(named, "position", "left").select(*items.columns, "work_id", F.coalesce("best_match", F.lit("")).alias("best_match"), ratio.alias("ratio"), (ratio >= least).alias("found"))
