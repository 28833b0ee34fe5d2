"""What leaves out pairs of lines early, and the test for long tokens."""

import random
import re

from pyspark.sql import functions as F

from bibloom.llm import line_dedup


def test_first_words_of_bitmaps_lose_nothing_and_leave_out_most(spark):
    rng, texts = random.Random(8), []
    for _ in range(60):
        base = "".join(rng.choices("abcdefgh ", k=300))
        texts += [base, base[: rng.randint(0, 290)] + rng.choice("xyz") + base[rng.randint(280, 300) :], base[:150] + "xx" + base[150:]]
    sets = [{t[i : i + 5] for i in range(max(1, len(t) - 4))} for t in texts]
    alike = {(a, b) for b in range(len(texts)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    bitmaps = line_dedup._bitmaps(spark.createDataFrame(list(enumerate(texts)), "rep long, norm string"))
    x, y = line_dedup._side(bitmaps, "a", "n", "x", line_dedup.FIRST), line_dedup._side(bitmaps, "b", "m", "y", line_dedup.FIRST)
    assert len(x.columns) == 2 + line_dedup.FIRST < 2 + line_dedup.WORDS
    got = {(r.a, r.b) for r in x.join(y, F.expr("a < b")).where(line_dedup._may_link(line_dedup.FIRST)).select("a", "b").collect()}
    assert alike <= got and len(alike) >= 60 and len(got) < 2 * len(alike) + 300


def test_one_bucket_met_by_first_words_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 4)
    rng, texts = random.Random(5), []
    for _ in range(12):
        base = "".join(rng.choices("abcdefgh ", k=200))
        texts += [base, base[:100] + "x" + base[100:]]
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in texts]
    alike = {(a, b) for b in range(24) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    bitmaps = line_dedup._bitmaps(spark.createDataFrame(list(enumerate(texts)), "rep long, norm string"))
    held = spark.createDataFrame([(0, 8, k, k, 24) for k in range(24)], "band int, bucket long, rep long, comp long, size long")
    got = [(r.a, r.b) for r in line_dedup._met(held, bitmaps).collect()]
    assert len(got) == len(set(got)) and alike <= set(got) and len(alike) == 12 and len(got) < 24


def test_long_tokens_are_found_as_by_trying_each_letter(spark):
    rng = random.Random(2)
    lines = ["".join(rng.choices("ab\u00e9\u6625 ", weights=(9, 9, 2, 1, rng.choice((1, 3))), k=rng.randint(0, 60))) for _ in range(3000)] + ["", " ", " " * 20, "x" * 12, "x" * 13, "  " + "x" * 13, "x" * 12 + " " + "y" * 13]
    rows = spark.createDataFrame([(t,) for t in lines], "norm string").select("norm", F.col("norm").rlike(line_dedup.LONG).alias("long")).collect()
    assert all(r.long == bool(re.search("[^ ]{13}", r.norm)) for r in rows) and 500 < sum(r.long for r in rows) < 2900
