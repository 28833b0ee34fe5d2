"""Evidence rows: quote checks, quantities and conditions, candidate contradictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibloom.functions.numeric import numeric_value, quote_supports


def checked(rows: DataFrame, fields: list[str]) -> DataFrame:
    """rows with accepted (has a quote) and unsupported (fields whose number the quote does not show; such rows stay)."""
    has = F.trim(F.coalesce("source_quote", F.lit(""))) != ""
    missing = [F.when((F.coalesce(F.col(f), F.lit("")) != "") & ~quote_supports(F.col(f), F.col("source_quote")), F.lit(f)) for f in fields]
    return rows.withColumn("accepted", has).withColumn("unsupported", F.when(has, F.array_compact(F.array(*missing))).otherwise(F.array().cast("array<string>")))


def column_kinds(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, quantity): a quantity has a value and only numbers. One pass over the rows."""
    cells = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("cell")) for f in fields])).alias("c")).select("c.*")
    filled = F.coalesce(F.col("cell"), F.lit("")) != ""
    return cells.groupBy("field").agg((F.coalesce(F.bool_and(F.when(filled, numeric_value(F.col("cell")).isNotNull())), F.lit(False)) & (F.count_if(filled) > 0)).alias("quantity"))


def conflicts(rows: DataFrame, quantities: list[str], conditions: list[str], ratio: float = 3.0, papers: int = 2) -> DataFrame:
    """Groups of equal conditions whose values spread by `ratio` or more between distinct papers, with the rows at both ends.

    rows: cite_key, the fields as text and position (input order), source_quote and confidence where there are any. Ties:
    the first row for low, the last for high. Rows are counted per paper first, as plain numbers; only the groups that
    spread enough meet their rows again, for what they say.
    """
    stated = [F.coalesce(F.nullif(F.trim(F.regexp_replace(F.lower(F.col(c).cast("string")), r"\s+", " ")), F.lit("")), F.lit("(unstated)")).alias(c) for c in conditions]
    told = [(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")).alias(c) for c in ("source_quote", "confidence")]
    cells = F.array(*[F.struct(F.lit(q).alias("field"), F.col(q).cast("string").alias("as_written"), numeric_value(F.col(q).cast("string")).alias("value")) for q in quantities])
    long = rows.select(F.coalesce(F.col("cite_key"), F.lit("")).alias("cite_key"), "position", *told, *stated, F.explode(cells).alias("q")).select("cite_key", "position", "source_quote", "confidence", *conditions, "q.*").where("value > 0")
    key = ["field", *conditions]
    paper = long.groupBy(*key, "cite_key").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    wide = paper.groupBy(*key).agg(F.sum("n").alias("rows"), F.count("*").alias("papers"), F.min("low").alias("low"), F.max("high").alias("high")).where((F.col("papers") >= papers) & (F.col("high") / F.col("low") >= ratio))
    ends = long.join(wide, key).where((F.col("value") == F.col("low")) | (F.col("value") == F.col("high")))
    end = F.struct("cite_key", "as_written", "confidence", "source_quote")
    at = lambda side: F.when(F.col("value") == F.col(side), F.col("position"))
    found = ends.groupBy(*key, "rows", "papers", "low", "high").agg(F.min_by(end, at("low")).alias("low_row"), F.max_by(end, at("high")).alias("high_row"))
    return found.where(F.col("low_row.cite_key") != F.col("high_row.cite_key")).withColumns({"ratio": F.col("high") / F.col("low"), "low_key": F.col("low_row.cite_key"), "high_key": F.col("high_row.cite_key")})


def evidence_csv(rows: DataFrame, fields: list[str]) -> DataFrame:
    """The columns of the evidence file; rows without a quote are refused, unknown columns ignored."""
    columns = ["cite_key", "doi", "year", *fields, "source_quote", "confidence", "note"]
    return rows.where(F.trim(F.coalesce("source_quote", F.lit(""))) != "").select(*columns)
