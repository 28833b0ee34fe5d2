"""Whitening, spelling variants and quality rules against plain versions, with nulls, ties, repeats and odd texts."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from bibloom.llm import quality, spelling, whitening
from bibloom.llm.queries import ORACLE_SQL

INF, NAN = float("inf"), float("nan")


def vectors(seed, n, d):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, d)) @ np.diag(np.linspace(1.5, 0.1, d)) @ np.linalg.qr(rng.standard_normal((d, d)))[0] + 0.3).astype(np.float32)


def embedded(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n long, component int").repartition(5)


def plain_whitening(rows, k=4):
    kept = [(i, [0.0 if c == 0 else float(np.float32(c)) for c in v]) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(v) for _, v in kept)
    x = [[math.floor(256 * c) for c in v] + [0] * (d - len(v)) for _, v in kept]
    own = np.array(sorted(set(map(tuple, x))), float)
    n, sums = len(own), [sum(r[j] for r in set(map(tuple, x))) for j in range(d)]
    mean = np.array([s / n for s in sums])
    cov = (own - mean).T @ (own - mean) / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return [(i, n, sum((n * a - s) ** 2 for a, s in zip(r, sums)), (np.array(r) - mean) @ u / np.sqrt(e)) for (i, _), r in zip(kept, x)], e / np.trace(cov)


def same_whitening(spark, rows, **kw):
    df = embedded(spark, rows)
    got = whitening.whitened(df, whitening.fit(df, **kw)).collect()
    want, share = plain_whitening(rows)
    key = lambda i: -1 if i is None else i
    by = defaultdict(list)
    for r in got:
        by[key(r.vec_id), r.deviation].append(r)
        assert r.identity_error <= 1e-4 and r.n == want[0][1] and r.deviation == r.deviation_exact
        assert abs(r.explained / share[r.component - 1] - 1) < 1e-9
    assert len(got) == 4 * len(want)
    for k in range(4):
        pairs = sorted((key(i), dev, w[k]) for i, _, dev, w in want)
        mine = sorted((i, dev, r.whitened) for (i, dev), rs in by.items() for r in rs if r.component == k + 1)
        assert [p[:2] for p in pairs] == [m[:2] for m in mine]
        a, b = np.array([p[2] for p in pairs]), np.array([m[2] for m in mine])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8


def test_whitening_equals_numpy(spark):
    rows = [(i, [float(c) for c in v], 0, 0) for i, v in enumerate(vectors(1, 200, 24))]
    rows += [(7, rows[3][1], 0, 0), (7, rows[3][1], 0, 0), (None, rows[5][1], 0, 0), (500, None, 0, 0), (501, [None] * 24, 0, 0), (502, [NAN] * 24, 0, 0), (503, [INF] + [0.0] * 23, 0, 0), (504, [], 0, 0), (505, [0.5, -0.0, 0.25], 0, 0)]
    same_whitening(spark, rows)


def test_lanczos_restarts_from_ritz_vectors():
    rng = np.random.default_rng(6)
    u = np.linalg.qr(rng.standard_normal((60, 60)))[0]
    a = u @ np.diag(np.linspace(3, 0.1, 60)) @ u.T
    e, y, passes = whitening.leading(lambda q: a @ q, 60, 4, 4, 1e-12, 16, 400)
    assert passes > 15 and np.allclose(e, np.linspace(3, 0.1, 60)[:4]) and np.abs(np.abs(u[:, :4].T @ y) - np.eye(4)).max() < 1e-8


def test_whitening_without_variance(spark):
    df = embedded(spark, [(i, [0.5, 0.25], 0, 0) for i in range(4)])
    assert whitening.fit(df) is None and whitening.whitened(df, None).count() == 0
    empty = embedded(spark, [])
    assert whitening.whitened(empty, whitening.fit(empty)).collect() == []
    flat = embedded(spark, [(i, [float(i), 0.5, 2.0 * i], 0, 0) for i in range(9)])
    assert {r.component for r in whitening.whitened(flat, whitening.fit(flat)).collect()} == {1}


def test_whitening_keeps_large_entries_exact(spark):
    rows = [(i, [1e30 if i == 0 else float(i), float(2**40 + i * 2**20), -3.5 * i], 0, 0) for i in range(6)]
    df = embedded(spark, rows)
    got = {r.vec_id: r for r in whitening.whitened(df, whitening.fit(df)).collect()}
    x = {i: [min(math.floor(256 * float(np.float32(c))), 2**63 - 1) for c in v] for i, v, *_ in rows}
    sums = [sum(c) for c in zip(*x.values())]
    for i, v in x.items():
        exact = sum((6 * a - s) ** 2 for a, s in zip(v, sums))
        assert got[i].deviation == (exact if exact < 2**63 else None)
        assert got[i].deviation_exact == (exact if exact < 10**38 else None)


def test_lanczos_breaks_down_and_goes_on():
    rng = np.random.default_rng(3)
    u = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    value = np.array([5.0, 5.0, 5.0, 2.0, 2.0] + [0.0] * 25)  # blocks lose rank at once
    a = u @ np.diag(value) @ u.T
    e, y, _ = whitening.leading(lambda q: a @ q, 30, 4, 2, 1e-12, 512, 100)
    assert np.allclose(e, [5, 5, 5, 2]) and np.allclose(a @ y, y * e) and np.allclose(y.T @ y, np.eye(4))
    with pytest.raises(RuntimeError):
        whitening.leading(lambda q: np.diag(np.arange(30.0)) @ q, 30, 4, 2, 1e-14, 8, 3)


def spelt(spark):
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(5, 12))) for _ in range(60)]
    words = stems + [s[:k] + c + s[k + 1 :] for s in stems for k in (0, 3) for c in "aé"] + [s + c for s in stems for c in "ab"] + ["a" + s for s in stems] + [s[:2] + s[3:] for s in stems]
    texts = [" ".join(rng.choice(words[: rng.choice((60, 300, len(words)))]) for _ in range(400)) for _ in range(40)]
    rows = [*enumerate(texts), (None, texts[0]), (3, texts[3]), (3, texts[3].upper()), (90, None), (91, ""), (92, "kurz 123 _ÀÖ÷×ÿA" * 6), (93, "x" * 30_000), (94, "kettenwort " * 400 + "kettenworta " * 60 + "kettenwortab " * 8)]
    return rows, spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n long").repartition(3)


def plain_variants(rows):
    n = Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}

    def edited(w):
        letters = {c for x in n for c in x}
        yield from (w[:k] + w[k + 1 :] for k in range(len(w)))
        yield from (w[:k] + c + w[k + j :] for k in range(len(w) + 1) for c in letters for j in (0, 1))

    near = {w: {x for x in edited(w) if x in n and x != w} for w in n}
    form = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= 5 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


@pytest.mark.parametrize("most", [2000, 3])
def test_spelling_equals_plain_loops(spark, most):
    rows, docs = spelt(spark)
    got = spelling.variants(docs, most).collect()
    want = plain_variants(rows)
    assert len(want) > 150 and any(f for _, f, *_ in want) and any(f and r != f for _, f, r, *_ in want)
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_spelling_refines_hot_keys(spark):
    rows, docs = spelt(spark)
    words = spelling.written(spelling.counted(docs), "words")
    keys = spelling.dealt(words, 3)
    sizes = keys.groupBy(*spelling._KEY).count().where("m - p - s > 1")
    assert sizes.where("count > 3").count() == 0 and keys.where("p + s > (m + 1) div 2").count() > 0


def test_heap_merge_counts():
    rng = random.Random(1)
    for need in (1, 2, 3):
        lists = [sorted(rng.sample(range(40), 15)) for _ in range(4)]
        count = Counter(x for held in lists for x in held)
        assert list(spelling.merged([(held, 0) for held in lists], need)) == sorted(x for x, c in count.items() if c >= need)


def test_spelling_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "a few short ones")], "doc_id long, text string")).collect() == []


def test_spelling_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = db.execute(f"SELECT word, form, root, n, n_near, form_n FROM ({ORACLE_SQL['op12_spelling_variants']})").fetchall()
    assert {tuple(r) for r in spelling.variants(spark.read.parquet(path)).collect()} == set(want)


def plain_measures(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    windows = defaultdict(list)
    for k in range(len(words) - 4):
        windows[tuple(words[k : k + 5])].append(k)
    cover = {k + j for held in windows.values() if len(held) > 1 for k in held for j in range(5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(cover))


WELL = "The quick brown fox jumps over the lazy dog while seven small birds sing about early spring mornings near rivers."


def assessed_rows():
    rng = random.Random(2)
    vocabulary = [f"{a}{b}" for a in ("lo", "mi", "ta", "nu", "re") for b in ("ka", "sen", "dor", "vil", "mer", "pa", "ston")]
    prose = lambda k: " ".join(rng.choice(vocabulary) + ("." if rng.random() < 0.1 else "") for _ in range(k)) + "."
    good = [prose(rng.randrange(20, 200)) + "\n" + prose(30) for _ in range(150)]
    noisy = [" ".join(w + rng.choice(("$$$", "&&&", "###")) for w in prose(80).split()) for _ in range(12)] + [" | ".join(prose(60).split()) for _ in range(12)]
    odd = [None, "", " \n\t", "one", "a b c d e " * 30, "same line here\n" * 20, "x" * 50_000, "a\x0bb\x0cc\rd\xa0e　f \x1cg", "é漢字🎉 " * 12, "a a a a a a", "1 2 3 4 5 6 1 2 3 4 5 7 8 9 0 1 2 3 4 5", WELL]
    return list(enumerate(good + noisy + odd)), len(good), len(noisy)


def test_quality_equals_plain_loops(spark):
    rows, good, noisy = assessed_rows()
    rows += [(None, WELL), (3, rows[3][1]), (3, rows[3][1])]
    docs = spark.createDataFrame([(i, t, 1, [1]) for i, t in rows], "doc_id long, text string, n_words int, votes array<int>").repartition(4)
    got = quality.assessed(docs).collect()
    key = lambda i, *m: (-1 if i is None else i, *m)
    assert sorted(key(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted(key(i, *plain_measures(t)) for i, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)
    kept = {r.doc_id for r in got if r.kept}
    assert set(range(good)) <= kept and None in kept and not kept & set(range(good, good + noisy))


def test_quality_model_over_patterns_is_the_model_over_documents(spark):
    rows, *_ = assessed_rows()
    votes = quality.written(quality.voted(quality.measures(spark.createDataFrame(rows, "doc_id long, text string"))), "votes")
    model = quality.fit(votes)
    each = np.array([r.votes for r in votes.where(~quality.base_failed()).collect()], float)
    again = quality.expectation_maximisation(each, np.ones(len(each)))
    assert np.allclose(again.on_good, model.on_good) and np.allclose(again.on_bad, model.on_bad) and abs(again.prior - model.prior) < 1e-8
    for r in quality.judged(votes, model).collect():  # Bayes' rule, written out
        good, bad = model.prior, 1 - model.prior
        for v, a, b in zip(r.votes, model.on_good, model.on_bad):
            good *= a if v > 0 else 1 - a if v < 0 else 1
            bad *= 1 - b if v > 0 else b if v < 0 else 1
        assert abs(r.posterior - good / (good + bad)) < 1e-9


def test_quality_recovers_planted_accuracies():
    rng = np.random.default_rng(4)
    good = rng.random(20_000) < 0.85
    on_good, on_bad = np.array([0.97, 0.95, 0.99, 0.9, 0.96]), np.array([0.7, 0.8, 0.5, 0.6, 0.9])
    right = rng.random((20_000, 5)) < np.where(good[:, None], on_good, on_bad)
    votes = np.where(right == good[:, None], 1, -1) * (rng.random((20_000, 5)) < 0.9)
    model = quality.expectation_maximisation(votes.astype(float), np.ones(len(votes)))
    assert abs(model.prior - 0.85) < 0.02 and np.abs(model.on_good - on_good).max() < 0.02 and np.abs(model.on_bad - on_bad).max() < 0.06


def test_repeated_words_of_wide_vocabularies():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 1 << 20, 3000)
    ids[2000:2012] = ids[100:112]
    assert quality.repeated_words(ids) == 24 and quality.repeated_words(np.zeros(0, np.int64)) == 0 and quality.repeated_words(np.zeros(6, np.int64)) == 6


def test_quality_of_nothing_and_filter(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert quality.assessed(empty).collect() == [] and quality.filtered(empty).collect() == []
    docs = spark.createDataFrame([(1, WELL, "en"), (2, "no", None), (3, None, "en")], empty.schema)
    assert [tuple(r) for r in quality.filtered(docs).collect()] == [(1, WELL, "en")]
