"""Known items against all pairs, gold recall by the rules, checks that fail."""

import random

import pytest

from bibloom.functions import text as T
from bibloom.operators import screening


def titles(seed, n):
    rng = random.Random(seed)
    words = "tide harbour crane river bank winter spring ferry night light Über façade über 數 x".split()
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(n)]


def plain_best(title, works):
    best, at = 0.0, None
    for k, t in works:
        r = T.ratio(title.lower(), t.lower()) if title and t else 0.0
        if r > best:
            best, at = r, k
    return best, at


@pytest.mark.parametrize("block", [4096, 5])
def test_known_items_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(screening, "ITEMS", block)
    works = [(k, t) for k, t in enumerate(titles(1, 150) + ["", None] + ["a long title " * 30, "a long title " * 29 + "b"])]
    works += [(500, works[3][1]), (501, works[3][1].upper())]
    items = [(k, t) for k, t in enumerate([*titles(2, 25), works[3][1], "zzz", "", None, "q" * 5, "a long title " * 31])]
    w = spark.createDataFrame([(k, k + 9000, t) for k, t in works], "position long, work_id long, title string").repartition(4)
    got = {r.item_id: (r.ratio, r.work_id, r.found, r.best_match) for r in screening.known_items(spark.createDataFrame(items, "item_id long, title string"), w).collect()}
    assert len(got) == len(items)
    by = dict(works)
    some_below = 0
    for k, t in items:
        best, at = plain_best(t, [(p, x) for p, x in works if x])
        assert got[k] == (best, None if at is None else at + 9000, best >= 0.8, "" if at is None else by[at])
        some_below += 0 < best < 0.8
    assert some_below > 5


def test_gold_recall_rules(spark):
    gold = spark.createDataFrame([("a", "https://doi.org/10.5/A"), ("b", "10.5/b"), (None, "doi:10.5/c"), ("d", "no doi"), ("e", None)], "key string, doi string")
    works = spark.createDataFrame([("10.5/a", "include", "verified", 1), ("10.5/a", "", "", 2), ("10.5/b", "unsure", "quarantined", 3), ("", "include", "", 4), (None, "include", "", 5)], "doi string, screen string, validation string, position long")
    out = screening.gold_recall(gold, works)
    assert {(r.doi, r.found, r.screen, r.validation) for r in out.collect()} == {("https://doi.org/10.5/A", True, "unscreened", ""), ("10.5/b", True, "unsure", "quarantined"), ("doi:10.5/c", False, "", ""), ("no doi", False, "", ""), (None, False, "", "")}
    assert {tuple(r) for r in screening.gold_missed(out).collect()} == {("b", "screened_out"), ("10.5/c", "missed"), ("d", "missed"), ("e", "missed")}
    assert tuple(screening.gold_summary(out).first()) == (5, 2, 1, 40.0)
    assert tuple(screening.gold_summary(out.limit(0)).first()) == (0, 0, 0, 0.0)


@pytest.mark.parametrize(("found", "total"), [(1333, 2000), (49, 400), (3, 2000), (1, 3), (131, 200)])
def test_recall_is_rounded_as_a_double(spark, found, total):
    rows = spark.range(total).selectExpr(f"id < {found} as found", "'' as screen")
    assert screening.gold_summary(rows).first().recall_pct == round(100 * found / total, 1)


def test_of_equal_echoes_at_a_place_the_earlier_document_stays(spark, tmp_path):
    from bibloom.plans.queries import QUERIES

    spark.createDataFrame([(11, "one title twice here", "en", "s", 20), (12, "one title twice here", "en", "s", 20)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for k, order in enumerate(([11, 12], [12, 11])):
        spark.createDataFrame([(i, int(i == 11), 0) for i in order], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/{k}/labels.parquet")
        (tmp_path / str(k) / "documents.parquet").symlink_to(tmp_path / "documents.parquet")
        out = QUERIES["verdict_align"](spark, f"{tmp_path}/{k}").first()
        assert (out["include"], out["exclude"]) == (1, 0)
