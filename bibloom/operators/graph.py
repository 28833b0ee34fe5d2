"""Citation counts inside the corpus, ranking, reading phases, seeds and the expansion loop."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibloom.operators.relevance import year_of

ROLES = ("review", "primary", "method", "theory")


def in_corpus_citations(works: DataFrame) -> DataFrame:
    """(work_id, in_corpus): distinct other works of the corpus that cite each work; the last work owns a native id."""
    ids = works.select("position", F.col("work_id").alias("cited"), F.explode(F.map_values("source_ids")).alias("native"))
    owner = ids.groupBy("native").agg(F.max_by("cited", "position").alias("cited"))
    edges = works.select(F.col("work_id").alias("citer"), F.explode(F.array_distinct("references")).alias("native"))
    return counted(edges.join(owner, "native").select("citer", "cited"), works)


def counted(edges: DataFrame, works: DataFrame) -> DataFrame:
    """(work_id, in_corpus) from edges (citer, cited); works nobody cites have 0."""
    counts = edges.where("citer <> cited").distinct().groupBy(F.col("cited").alias("work_id")).agg(F.count("*").alias("in_corpus"))
    return works.select("work_id").join(counts, "work_id", "left").select("work_id", F.coalesce("in_corpus", F.lit(0)).cast("long").alias("in_corpus"))


def signals(works: DataFrame, now_year: int) -> DataFrame:
    """works (with in_corpus) and their year number and citations a year, at least one year counted; unknown years rate 0."""
    age = F.greatest(F.lit(1), F.lit(now_year) - F.col("year_number") + 1)
    rate = F.when(F.col("year_number").isNull(), 0.0).otherwise(F.round(F.col("cited_by_count") / age, 2))
    return works.withColumn("year_number", year_of(F.col("year"))).withColumn("rate", rate)


def rank_order() -> list:
    return [F.desc("rate"), F.desc("in_corpus"), F.desc("cited_by_count"), F.asc("position")]


def top(works: DataFrame, n: int) -> DataFrame:
    """The shortlist: a global order and a limit, no single-partition window."""
    return works.orderBy(*rank_order()).limit(n)


def phases(works: DataFrame, now_year: int, frontier_years: int = 3, landmark: int = 2) -> DataFrame:
    """works with phase (foundation, core or frontier) and part: reviews, then landmarks, then recent works, then the rest."""
    part = F.when(F.col("role") == "review", "reviews").when(F.col("in_corpus") >= landmark, "landmarks").when(F.col("year_number") > now_year - frontier_years, "frontier").otherwise("core")
    return works.withColumn("part", part).withColumn("phase", F.when(F.col("part").isin("reviews", "landmarks"), "foundation").otherwise(F.col("part")))


def role_counts(works: DataFrame) -> DataFrame:
    """(role, n) for every role and `unclassified`, zeros included."""
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("unclassified")
    counts = works.groupBy(role.alias("role")).agg(F.count("*").alias("n"))
    all_roles = works.sparkSession.createDataFrame([(r,) for r in (*ROLES, "unclassified")], "role string")
    return all_roles.join(counts, "role", "left").select("role", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def seeds(works: DataFrame, seen: DataFrame, n: int) -> DataFrame:
    """The next seeds: unseen explicit seeds in corpus order, then screened-in works (round 0 if none is) by citations."""
    screened = F.max(F.when(F.col("screen") == "include", 1).otherwise(0))
    some = works.agg(screened.alias("some"))
    eligible = F.col("is_seed") | F.when(F.col("some") == 1, F.col("screen") == "include").otherwise(F.col("found_in_round") == 0)
    rest = works.join(F.broadcast(some)).where(eligible).drop("some").join(seen, "work_id", "left_anti")
    return rest.orderBy(F.desc("is_seed"), F.when(~F.col("is_seed"), F.col("cited_by_count")).desc(), "position").limit(n)


def snowball(works: DataFrame, edges: DataFrame, rounds: int = 2, n_seeds: int = 10, saturation: float = 0.05, choose: Callable | None = None) -> tuple[DataFrame, list[dict]]:
    """Expands ids along edges (citer, cited) from the best works, round by round.

    works: the candidate works (work_id, cited_by_count, position, is_seed, screen, found_in_round); those with a null
    found_in_round are not in the corpus yet. Each round's corpus is written to the shared folder. Stops without seeds
    or when a round brings less than `saturation` of the corpus.
    """
    spark = works.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    seen, report = works.select("work_id").limit(0), []
    for k in range(1, rounds + 1):
        corpus = works.where("found_in_round is not null")
        picked = seeds(corpus, seen, n_seeds).select("work_id")
        if picked.isEmpty():
            break
        reached = edges.join(picked, edges["citer"] == picked["work_id"], "left_semi").select(F.col("cited").alias("id")).unionByName(edges.join(picked, edges["cited"] == picked["work_id"], "left_semi").select(F.col("citer").alias("id"))).distinct()
        grown = works.join(reached, works["work_id"] == reached["id"], "left").withColumn("found_in_round", F.coalesce("found_in_round", F.when(F.col("id").isNotNull(), F.lit(k)))).drop("id")
        seen = seen.unionByName(picked)
        if base:
            path = f"{base}/snowball-{uuid.uuid4().hex}"
            grown.write.parquet(f"{path}/works")
            seen.write.parquet(f"{path}/seen")
            grown, seen = spark.read.parquet(f"{path}/works"), spark.read.parquet(f"{path}/seen")
        new, size = grown.agg(F.count_if(F.col("found_in_round") == k), F.count("found_in_round")).first()
        works = grown
        report.append({"round": k, "new": new, "corpus": size, "new_fraction": round(new / size, 4) if size else 0.0})
        if not size or new / size < saturation:
            break
    return works, report
