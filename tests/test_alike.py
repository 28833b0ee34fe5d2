"""Ratios against difflib's, and how few of them the replay works out."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from bibloom.functions import text as T
from bibloom.operators import corpus
from bibloom.plans.queries import title_of


def _pairs(n):
    rng = random.Random(5)
    for _ in range(n):
        letters = rng.choice(["ab", "abc ", "abcdefgh é"])
        a = rng.choices(letters, k=rng.randint(0, 45))
        b = list(a) if rng.random() < 0.6 else rng.choices(letters, k=rng.randint(0, 45))
        for _ in range(rng.randint(0, 4)):
            b.insert(rng.randint(0, len(b)), rng.choice(letters))
        yield "".join(a), "".join(b)


def test_ratio_is_difflibs_and_bounds_lose_nothing():
    for a, b in [*_pairs(4000), ("a" * 250, "ba" * 120), ("ab" * 60, "ba" * 150)]:
        there, back = SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()
        assert T.ratio(a, b) == there
        assert T.Alike(a, 0.92).ways(b) == (there >= 0.92) + 2 * (back >= 0.92)


def test_replay_takes_alike_titles_as_told(monkeypatch):
    """Titles of the same letters in another order: none is alike, and no ratio is worked out in the one task of a component."""
    rng = random.Random(1)
    words = "one two three four five six seven".split()
    works = [{"held": -1, "doi": "", "publisher": "", "arxiv_id": "", "norm": " ".join(rng.sample(words, 7)), "n": 33, "year": "", "surname": "", "position": k, "last": k, "alike": None} for k in range(50)]
    works.append(works[0] | {"position": 50, "last": 50, "norm": works[0]["norm"] + "s", "n": 34, "alike": [works[0]["norm"]]})
    want = corpus.replay(iter(works), 0.92)
    monkeypatch.setattr(T, "ratio", lambda a, b: 1 / 0)
    assert corpus.replay(iter(works), 0.92, told=True) == want


def test_titles_are_the_first_words(spark):
    texts = ["", " ", "Ab-c 1.", "é", "ÀB cd" * 30, ", ".join(map(str, range(40))), "\nx\n" * 11, "Kİ x" * 9, None]
    old = F.array_join(F.slice(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1)), 1, 12), " ")
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(old.alias("old"), title_of().alias("new")).collect()
    assert [r.old for r in rows] == [r.new for r in rows]
