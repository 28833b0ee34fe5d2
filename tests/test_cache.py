"""The response log: latest entry wins, misses are answers, a batch's silence is not, compactions change nothing."""

from pyspark.sql import functions as F

from bibloom.sources import cache


def entries(spark, *rows):
    return spark.createDataFrame(list(rows), "key string, payload string")


def test_latest_entry_wins_through_compactions(spark, tmp_path):
    log = cache.ResponseLog(spark, str(tmp_path / "log"))
    keys = entries(spark, ("a", ""), ("b", ""), ("c", ""), ("d", "")).select("key")
    seen = lambda: {r.key: (r.known, r.payload) for r in log.lookup(keys).collect()}
    assert set(seen().values()) == {(False, None)} and log.compact() is None
    log.append(entries(spark, ("a", "1"), ("b", "1")))
    log.append(entries(spark, ("a", None), ("c", "2")))
    want = {"a": (True, None), "b": (True, "1"), "c": (True, "2"), "d": (False, None)}
    assert seen() == want
    log.compact()
    assert seen() == want
    number = log.append(entries(spark, ("a", "3")))
    log.append(entries(spark, ("a", "4")), number)  # run again: replaces itself
    assert seen() == want | {"a": (True, "4")}
    log.compact()
    assert seen() == want | {"a": (True, "4")} and log.unknown(keys).collect()[0].key == "d"


def test_a_base_cut_short_does_not_count(spark, tmp_path):
    log = cache.ResponseLog(spark, str(tmp_path / "log"))
    log.append(entries(spark, ("a", "1"), ("b", "1")))
    spark.createDataFrame([("a", "1", 0, 2)], cache.ROW).write.parquet(f"{log.root}/kind=base/batch=0")
    assert log.entries().count() == 2


def test_a_miss_in_a_batch_is_not_stored_as_absent(spark, tmp_path):
    log = cache.ResponseLog(spark, str(tmp_path / "log"))
    log.append(entries(spark, ("k0", "old"), ("k1", None)))
    keys = spark.range(130).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    asked = []

    def answer(batches):
        asked.extend(batches.collect())
        return batches.select(F.explode("keys").alias("key")).withColumn("payload", F.when(~F.col("key").endswith("7"), F.col("key")))

    assert cache.prefetched(log, keys.unionByName(keys), answer) == 115
    assert sorted(len(r.keys) for r in asked) == [28, 50, 50] and not {"k0", "k1"} & {k for r in asked for k in r.keys}
    left = {r.key: (r.known, r.payload) for r in log.lookup(keys).collect()}
    assert left["k7"] == (False, None) and left["k1"] == (True, None) and left["k0"] == (True, "old") and left["k8"] == (True, "k8")


def test_batches_are_full_over_many_groups(spark, monkeypatch):
    monkeypatch.setattr(cache, "GROUP", 37)
    found = cache.request_batches(spark.range(1003).select(F.col("id").cast("string").alias("key")), 50).collect()
    assert sorted(r.batch for r in found) == list(range(21)) and sorted(len(r.keys) for r in found) == [3] + [50] * 20
    assert sorted(int(k) for r in found for k in r.keys) == list(range(1003))


def test_keys(spark):
    one = spark.range(1).select(cache.key_of("crossref:doi", F.lit(" 10.5/ABC ")), cache.key_of("crossref:search", F.lit("Tides, at Night"), F.lit("Quill"), F.lit("")), cache.key_of("arxiv", F.lit(" 1905.04321v2")), cache.key_of("openalex:search", F.lit("Über")))
    assert tuple(one.first()) == ("crossref:doi:10.5/abc", "crossref:search:tides at night quill", "arxiv:1905.04321v2", "openalex:search:uber")
