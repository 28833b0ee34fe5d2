"""Corpus, verdict, evidence, gold and BibTeX files as DataFrames, and their writers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bibloom.sources.schema import TEXT_FIELDS, VERDICT, WORK

VERDICTS = ("include", "exclude", "unsure")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSONL files with an order: file, then the line's place in it."""
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return lines


def read_works(spark: SparkSession, path: str) -> DataFrame:
    """Works from JSON lines, unknown keys ignored, absent text empty."""
    return spark.read.schema(WORK).json(path).fillna("", list(TEXT_FIELDS))


def write_works(works: DataFrame, path: str) -> None:
    """Works as JSON lines in corpus order: part files follow one another by position, and are sorted inside."""
    columns = [F.col(c.split(" ")[0]) for c in WORK.split(", ")]
    line = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    works.repartitionByRange(F.col("position")).sortWithinPartitions("position").select(line.alias("value")).write.mode("overwrite").text(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus file read as it was built: its works added in order, so that works that are one by now become one."""
    from bibloom.operators.corpus import deduplicated

    lines = _numbered(spark, path).where(F.trim("value") != "")
    at = lines.select("file", "block", "line", F.from_json("value", WORK).alias("w"))
    # numbered per block, the blocks' sizes give each its first number
    inside = at.withColumn("k", F.row_number().over(Window.partitionBy("file", "block").orderBy("line")) - 1)
    sizes = at.groupBy("file", "block").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = inside.join(sizes.select("file", "block", "first"), ["file", "block"]).withColumn("position", F.col("first") + F.col("k"))
    works = placed.select("position", F.col("position").alias("work_id"), "w.*").fillna("", list(TEXT_FIELDS)).fillna(0, ["cited_by_count", "found_in_round"]).fillna(False, ["is_seed"])
    for c in ("authors", "sources", "references"):
        works = works.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return deduplicated(works.withColumn("source_ids", F.coalesce("source_ids", F.create_map().cast("map<string,string>"))))


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """(index, t, verdict, reason, role): the last well-formed line of each index; unknown roles are empty."""
    rows = _numbered(spark, path).select("file", "block", "line", F.from_json("value", VERDICT).alias("v")).select("file", "block", "line", "v.*")
    rows = rows.withColumn("index", F.when(F.col("index").isin("true", "false"), F.when(F.col("index") == "true", 1).otherwise(0)).otherwise(F.col("index").try_cast("long")))
    good = rows.where(F.col("index").isNotNull() & F.col("verdict").isin(*VERDICTS))
    last = good.groupBy("index").agg(F.max_by(F.struct("t", "verdict", "reason", "role"), F.struct("file", "block", "line")).alias("r"))
    role = F.when(F.col("r.role").isin("review", "primary", "method", "theory"), F.col("r.role")).otherwise("")
    return last.select("index", F.coalesce("r.t", F.lit("")).alias("t"), "r.verdict", F.coalesce("r.reason", F.lit("")).alias("reason"), role.alias("role"))


def read_evidence(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Evidence rows, every cell as text, malformed lines skipped. Without a file there are no rows."""
    columns = ["cite_key", "doi", "year", *fields, "source_quote", "confidence", "note"]
    schema = ", ".join(f"`{c}` string" for c in columns)
    try:
        lines = _numbered(spark, path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], f"position long, {schema}")
        raise
    parsed = lines.where(F.try_parse_json("value").isNotNull() & F.trim("value").startswith("{"))
    return parsed.select(F.col("line").alias("position"), F.from_json("value", schema).alias("v")).select("position", "v.*")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold papers from an object with `papers`, or from a bare list."""
    paper = "doi string, key string, year int, title string"
    whole = spark.read.text(path, wholetext=True)
    listed = F.coalesce(F.from_json("value", f"papers array<struct<{paper.replace(' string', ':string').replace(' int', ':int')}>>")["papers"], F.from_json("value", f"array<struct<{paper.replace(' string', ':string').replace(' int', ':int')}>>"))
    return whole.select(F.explode(listed).alias("p")).select("p.*")


def read_bib(spark: SparkSession, path: str) -> DataFrame:
    """(file, source) of BibTeX files: UTF-8, else cp1252, else with replacements."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), decoded(F.col("content")).alias("source"))


def decoded(content):
    import pandas as pd

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(b: bytes) -> str:
            for name in ("utf-8", "cp1252"):
                try:
                    return b.decode(name)
                except UnicodeDecodeError:
                    pass
            return b.decode("utf-8", "replace")

        return s.map(one)

    return run(content)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)
