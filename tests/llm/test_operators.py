"""Each training-data operator against a brute-force version on small fixtures, with nulls, ties and odd texts."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from bibloom.llm import cross_polytope, exact_dedup, html_extraction, language, line_dedup, near_dedup, packing, sentencepiece_backend, substring_dedup, token_counts
from bibloom.llm.common import components, word_hashes
from bibloom.llm.queries import vocabulary

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ra", "si", "to", "vu", "ze") for b in ("ba", "ce", "di", "fo", "gu", "ha", "je", "ki", "lu", "mo")]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(text, k, seed):
    words, rng = text.split(), random.Random(seed)
    for _ in range(k):
        words[rng.randrange(len(words))] = "changed" + str(rng.randrange(1000))
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    base = [prose(120, s) for s in range(12)]
    rows = [None, "", "   ", "one", "One", "two words", base[0], base[0].upper(), "x" * 20_000, "a\tb\nc  d\r\n é 漢字 🎉"]
    rows += base + [edited(b, k, s) for s, b in enumerate(base) for k in (1, 2, 4, 8)]
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(d, t, "en", "extra") for d, t in texts], "doc_id long, text string, lang string, kept string").repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def linked_components(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 99)], "a long, b long")
    assert {r["id"]: r["component"] for r in components(edges).collect()} == {k: 0 for k in range(61)} | {99: 99, 100: 99}


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    from bibloom.llm import common

    one, at = word_hashes(["Aa b\x0bc", "", "aA  B"])
    assert at.tolist() == [0, 3, 3, 5] and one[0] == one[3] and one[1] == one[4]
    monkeypatch.setattr(common, "BLOCK_BYTES", 4)
    assert word_hashes(["Aa b\x0bc", "", "aA  B"])[0].tolist() == one.tolist()


@pytest.mark.parametrize(("words", "percent", "node"), [(3, 85, 256), (5, 80, 256), (3, 60, 6)])
def test_near_dedup(spark, docs, texts, monkeypatch, words, percent, node):
    monkeypatch.setattr(near_dedup, "NODE", node)
    sets = []
    for _, t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", lower(t)) if x]
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = linked_components(len(sets), links)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs, words, percent).collect()}
    assert [got[d]["component_id"] for d in range(len(sets))] == want
    assert all(got[d]["n_shingles"] == len(sets[d]) and got[d]["kept"] == (want[d] == d) for d in got)


def test_near_dedup_trees_branch_by_coordinates_of_their_own(spark):
    texts = spark.createDataFrame([(k, edited(prose(120, 1), 6, k)) for k in range(40)], "rep long, text string")
    n = spark.createDataFrame([(t, k, 360, t) for k in range(40) for t in range(near_dedup.TREES)], "node long, rep long, n long, tree int")
    rows = near_dedup._branched(n, texts, 0, 3, 85).collect()
    held = [defaultdict(set) for _ in range(near_dedup.TREES)]
    for r in rows:
        held[r["tree"]][r["node"]].add(r["rep"])
    met = [{(a, b) for reps in h.values() for a in reps for b in reps if a < b} for h in held]
    assert all(met[a] != met[b] for a in range(len(met)) for b in range(a))
    assert len({k for h in held for k in h}) == sum(map(len, held)) and len(set.union(*met)) > max(map(len, met))


def test_near_dedup_of_a_templated_group(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "NODE", 32)
    template, rows = prose(270, 9), []
    for k in range(1200):
        own = template + " " + prose(50, 1000 + k // 2)
        rows.append((k, own if k % 2 else edited(own, 8, k)))
    sets = []
    for _, t in rows:
        w = t.split()
        sets.append(frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)))
    # texts of two pairs share at most about the template, 268 of 368 shingles
    links = [(k + 1, k) for k in range(0, len(rows), 2) if 100 * len(sets[k] & sets[k + 1]) >= 85 * len(sets[k] | sets[k + 1])]
    want = linked_components(len(sets), links)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert len(links) > 500 and [got[k] for k, _ in rows] == want


def test_exact_dedup(docs, texts):
    groups = defaultdict(list)
    for d, t in texts:
        groups[lower(t)].append(d)
    want = {d: (max(v), len(v), d == max(v), hashlib.sha256(k.encode()).hexdigest()) for k, v in groups.items() for d in v}
    for split in (None, -1, 10**9):
        assert {r["doc_id"]: tuple(r)[1:] for r in exact_dedup.dedup(docs, split).collect()} == want


def test_exact_dedup_without_ids(spark):
    big = 2**53
    rows = [(None, "a"), (big + 1, "b"), (big + 3, "c"), (None, "c"), (None, "d"), (None, "d"), (5, "C"), (7, None), (7, "")]
    got = sorted(tuple(r)[:4] for r in exact_dedup.dedup(spark.createDataFrame([(i, t, t) for i, t in rows], "doc_id long, text string, winner string")).collect() if r["doc_id"])
    assert got == [(5, big + 3, 3, False), (7, 7, 2, True), (7, 7, 2, True), (big + 1, big + 1, 1, True), (big + 3, big + 3, 3, True)]
    lost = exact_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id is null").collect()
    assert sorted((r["group_size"], r["keep_id"] is None, r["kept"]) for r in lost) == [(1, True, True), (2, True, True), (2, True, True), (3, False, False)]


def test_exact_dedup_deals_the_batch_too(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BUCKET", 50)
    seen, own = [], exact_dedup.lookup
    monkeypatch.setattr(exact_dedup, "lookup", lambda batch, index, buckets: seen.append(buckets) or own(batch, index, buckets))
    docs = spark.createDataFrame([(-(10**12), "one"), *((k, f"text {k}") for k in range(1000))], "doc_id long, text string")
    assert exact_dedup.dedup(docs).where("kept").count() == 1001 and seen == [21]


def test_perfect_hash_is_minimal_and_checked():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    levels, slot = exact_dedup.build_levels(keys)
    assert sorted(slot) == list(range(5000)) and (exact_dedup.find_slots(levels, keys) == slot).all()


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    ids = {d: np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for d, t in texts}
    rows = packing.pack(docs, path, length=64).collect()
    cover, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert bytes(r["ids"]) == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes() and r["doc_tokens"] == len(ids[r["doc_id"]])
        cover[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d in ids:
        ends = [s + n for s, n in sorted(cover[d])]
        assert [s for s, _ in sorted(cover[d])] == [0, *ends[:-1]] and ends[-1] == len(ids[d])
    for s in sequences.values():
        total = 0
        for offset, n in sorted(s):
            assert offset == total
            total += n
        assert total <= 64 and total & (total - 1) == 0


@pytest.mark.parametrize("text", ["", " a", "a ", "a  b", "a\n\nb", "<|endoftext|> x", "it's 12 o’clock\tnow", "é 漢字 🎉", "a\n b", "x y"])
def test_word_memory_equals_the_library(text):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.words_of(path).encode([text])[0], "<u2").tolist() == want


def test_hilbert_curve_is_a_path():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    key = packing.hilbert(cells, 3)
    path = cells[np.argsort(key)]
    assert sorted(key) == list(range(512)) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_token_counts_and_cache(spark, docs, texts):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    cache = token_counts.new_cache(spark)
    for _ in range(2):
        got = {r["doc_id"]: tuple(r)[1:] for r in token_counts.counts(docs, path, cache, limit=50).collect()}
        assert got == {d: (len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 50) for d, t in texts}
        assert spark.read.parquet(cache).count() == len({t or "" for _, t in texts})


def test_sentencepiece_parity_and_round_trip(docs, texts):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = sentencepiece_backend.decode(sentencepiece_backend.encode(docs, path), path).collect()
    assert sorted(rows) == sorted(sentencepiece_backend.round_trip(docs, path).collect())
    for r in rows:
        text = texts[r["doc_id"]][1] or ""
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == model.encode(text) and r["text"] == text and r["parity"]


def test_ids_are_those_of_the_rebuilt_pipeline():
    class Other:
        def encode(self, texts, num_threads=1):
            return [[7] for _ in texts]

    path = vocabulary("piece_bpe_32k.model")
    own = sentencepiece_backend.Backend(path)
    own.other = Other()
    (ids, parity), = own.encode(["two words"])
    assert not parity and own.decode([ids]) == ["two words"]


def test_decoding_equals_the_library():
    own = sentencepiece_backend.backend(vocabulary("piece_bpe_32k.model"))
    rng = np.random.default_rng(3)
    for ids in [[], [259, 260], [3 + 0xE6, 3 + 0xBC, 3 + 0xA2], [3 + 0xE6, 300], *rng.integers(3, 32000, (20, 12)).tolist()]:
        assert own.decode([np.array(ids, "<u4").tobytes()]) == [own.own.decode(ids, skip_special_tokens=False)]


def test_language(spark):
    rng = random.Random(5)
    sounds = {"xa": ["the", "and", "ing", "tion"], "yb": ["der", "und", "sch", "keit"]}
    rows = [(k, " ".join("".join(rng.choices(sounds[lang], k=2)) for _ in range(rng.randint(4, 60))), lang) for k in range(400) for lang in [("xa", "yb")[k % 2]]]
    rows += [(1000, None, "xa"), (1001, "12 34", "yb"), (1002, "the and", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.predict(docs, language.fit(docs)).collect()}
    held = [k for k, _, lang in rows[:400] if got[k]["held_out"]]
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k in got)
    assert np.mean([got[k]["lang_pred"] == rows[k][2] for k in held]) > 0.95
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und" and got[1000]["score"] == 0 and got[1002]["lang_pred"] == "xa"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_without_labels(empty):
    assert language.predict(empty, language.fit(empty)).count() == 0


def test_cross_polytope(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 24))
    rows = [v for b in base for v in (b, b * 2, b + rng.normal(size=24) * 0.05, b + rng.normal(size=24) * 0.2)]
    data = [(k, [float(x) for x in np.float32(v)], k % 3 and 1) for k, v in enumerate(rows)]
    data += [(900, data[1][1], 1), (901, data[1][1], None), (902, None, 1), (903, [0.0] * 24, 1), (904, [float("nan")] * 24, 1), (905, [], 1), (906, [1.0, 2.0], 1), (907, [None] + [1.0] * 23, 1)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    good = {k: (np.array(v, float), label) for k, v, label in data if v and None not in v and label is not None and np.isfinite(v).all() and any(v)}
    ids = [k for k, *_ in data]
    links = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] >= 0.98 * np.linalg.norm(good[a][0]) * np.linalg.norm(good[b][0])]
    place = {k: i for i, k in enumerate(ids)}
    want = linked_components(len(ids), [(place[a], place[b]) for a, b in links])
    got = {r["vec_id"]: r for r in cross_polytope.link(vectors).collect()}
    assert {k: got[k]["n_links"] for k in ids} == {k: sum(k in x for x in links) for k in ids}
    assert [got[k]["component_id"] for k in ids] == [ids[w] for w in want]


def extracted(spark, html):
    """Texts of pages of one host, in order."""
    pages = spark.createDataFrame([(k, "http://a.b/%d" % k, h, "x") for k, h in enumerate(html)], "page_id long, url string, html string, text string")
    rows = {r["page_id"]: r for r in html_extraction.extract(pages).collect()}
    assert all(rows[k]["n_chars"] == len(rows[k]["text"]) and rows[k]["url"] == "http://a.b/%d" % k for k in range(len(html)))
    return [rows[k]["text"] for k in range(len(html))]


def html_brute_force(html):
    """Plain loops: a block of an unmarked page goes if each of its words lies in three words, blocks apart alike, that three bodies hold."""
    read = [html_extraction.blocks(h) for h in html]
    kept, is_marked = [html_extraction.kept(r) for r in read], [any(p == html_extraction.INSIDE for p, _ in r) for r in read]
    held, bodies, grams_of = defaultdict(set), set(), {}
    for k, texts in enumerate(kept):
        body = "\n".join(texts)
        if is_marked[k]:
            bodies.add(body)
            for t in texts:
                held["block", t].add(body)
        else:
            stream = [(w, i) for i, t in enumerate(texts) for w in t.split()]
            grams_of[k] = [(tuple((w, d > 0 and stream[j + d][1] != stream[j + d - 1][1]) for d, (w, _) in enumerate(stream[j : j + 3])), j, stream) for j in range(len(stream) - 2)]
            for g, *_ in grams_of[k]:
                held[g].add(body)
    out = []
    for k, texts in enumerate(kept):
        if is_marked[k]:
            out.append("\n\n".join(t for t in texts if len(held["block", t]) < max(8, len(bodies) / 2)))
        else:
            covered = {j + d for g, j, _ in grams_of[k] if len(held[g]) >= 3 for d in range(3)}
            stream = [(w, i) for i, t in enumerate(texts) for w in t.split()]
            bare = {i for j, (w, i) in enumerate(stream) if j not in covered}
            out.append("\n\n".join(t for i, t in enumerate(texts) if i in bare))
    return out


def test_html_blocks_and_boilerplate(spark):
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav>Home About</nav><p>Subscribe to our weekly letter now</p><div><p>Unique {0} body &amp; more<br>text&nbsp;here</p><p>Second {0}</div><div class='comment-list'><p>nice</p></div><footer>f</footer>"
    out = extracted(spark, [page.replace("{0}", f"word{k} and word{k + 50}") for k in range(6)])
    assert out[2] == "Unique word2 and word52 body & more text here\n\nSecond word2 and word52"
    assert extracted(spark, ["<nav>menu</nav><article><h1>Same title</h1><p>Same text of copies</p></article>"] * 4) == ["Same title\n\nSame text of copies"] * 4


@pytest.mark.parametrize("tag", ["article", "div"])
def test_html_copies_stay(spark, tag):
    others = [f"<nav>menu</nav><{tag}><h1>Title {prose(3, k)}</h1><p>{prose(20, 50 + k)}</p></{tag}>" for k in range(2)]
    copies = [f"<nav>menu {k}</nav><{tag}><h1>Same title</h1><p>Same text of copies</p></{tag}>" for k in range(12)]
    assert extracted(spark, copies + others)[:12] == ["Same title\n\nSame text of copies"] * 12
    notice = "<p>The notice of this host</p>"
    assert extracted(spark, [f"<{tag}>{notice}<p>{prose(20, k)}</p></{tag}>" for k in range(10)]) == [prose(20, k) for k in range(10)]


def host_pages():
    """Unmarked pages with notices, menus without markup and composed lines; copies; marked pages; odd pages."""
    notice = "<p>The notice of this host stands here</p>"
    html = [f"<div>Home News About us</div>{notice if k % 12 == 0 else ''}<p>{prose(30, k)}</p><p>Read on {prose(2, k % 9)}</p>" for k in range(60)]
    html += [html[0]] * 9 + [f"<main><p>Part of the site</p>{prose(12, 200 + k)}</main>" for k in range(80)]
    return [*html, "", "<p>" + "long " * 60_000 + "</p>", "<div><p>open"]


def test_html_of_a_host_equals_plain_loops(spark, monkeypatch):
    html = host_pages()
    want = html_brute_force(html)
    assert extracted(spark, html) == want
    assert not any("notice" in t or "Home News" in t or "Part of the" in t for t in want) and all(len(t) > 100 for t in want[:60])
    monkeypatch.setattr(html_extraction, "CHUNK_BYTES", 600)  # the number of chunks changes nothing
    assert extracted(spark, html) == want


def test_html_depends_on_the_suffix_array(spark, monkeypatch):
    html = host_pages()[:60]
    want = extracted(spark, html)
    monkeypatch.setattr(html_extraction, "repeated", lambda pages, bodies: [np.ones(len(p), np.int64) for p in pages])
    without = [html_extraction._texts([p], html_extraction.repeated([p], [0]))[0] for p in ([*html_extraction.kept(html_extraction.blocks(h))] for h in html)]
    assert all(len(a) < len(b) and "Home News" in b for a, b in zip(want, without))


def test_html_keeps_what_an_article_says(spark):
    inside = "<p class='related-work'>Earlier studies</p><section class='social-history'><p>Of the town</p></section><p data-x='a hidden b'>Seen</p><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold</p>"
    gone = "<div class='share-buttons'>Share</div><div class='ad slot-3'>Buy</div><ul class='related-links'><li>More</li></ul><p hidden>Not seen</p><div hidden='hidden'>Nor this</div><aside>Side</aside><div id=comments>Nice</div>"
    assert extracted(spark, [f"<article><h1>Title</h1>{gone}{inside}{gone}</article>"]) == ["Title\n\nEarlier studies\n\nOf the town\n\nSeen\n\nLet x=2 hold"]


@pytest.mark.parametrize("chunk", [2 << 20, 300])
def test_html_headings_are_no_runs(spark, monkeypatch, chunk):
    monkeypatch.setattr(html_extraction, "CHUNK_BYTES", chunk)
    pages = [f"<div>Home News About</div><p>{prose(20, k)}</p><h2>Ingredients</h2><p>{prose(20, 30 + k)}</p><h2>Method</h2><p>{prose(20, 50 + k)}</p>" for k in range(4)]
    assert extracted(spark, pages) == [f"{prose(20, k)}\n\nIngredients\n\n{prose(20, 30 + k)}\n\nMethod\n\n{prose(20, 50 + k)}" for k in range(4)]


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.b/x", "<p>x"), (2, None, None), (3, "http://a.b/y", "")], "page_id long, url string, html string")
    assert {tuple(r) for r in html_extraction.extract(pages).collect()} == {(1, "http://a.b/x", "x", 1), (2, None, "", 0), (3, "http://a.b/y", "", 0)}


def test_substring_dedup(spark):
    passage = ". ".join(" ".join(prose(12, 100 + k).split()).capitalize() for k in range(6)) + "."
    rows = [(1, prose(30, 1) + ". " + passage + " " + prose(30, 2)), (2, "Own text of the second. " + passage + " Its end is its own."), (3, "Only mine here.\nLicensed under a public licence text.\nend"), (4, "Licensed under a public licence text.\nother"), (5, None), (6, ""), (7, "A b."), (8, "A b.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring_dedup.dedup(docs).collect()}
    assert got[1]["text"] == rows[0][1] and passage not in got[2]["text"] and "Own text of the second." in got[2]["text"] and "Its end is its own." in got[2]["text"]
    assert got[4]["text"] == "other" and got[3]["n_removed"] == 0 and got[5]["text"] is None and got[7]["text"] == got[8]["text"] == "A b."
    for d, t in rows:
        kept, at = "", 0
        for s in got[d]["removed"]:
            kept, at = kept + (t or "")[at : s["start"]], s["end"]
        assert (kept + (t or "")[at:]).replace("\n", "") == (got[d]["text"] or "").replace("\n", "")


def test_line_dedup(spark):
    long = prose(40, 7)
    rows = [(1, long + "\nshort\n\nunlike " + prose(20, 8)), (2, edited(long, 1, 3) + "\nshort"), (3, "  " + long.upper() + "  "), (4, None), (5, ""), (6, prose(40, 9) + "\n" + prose(40, 9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["line"]): (r["kept_doc_id"], r["kept_line"], r["kept"]) for r in line_dedup.fuzzy_lines(docs).collect()}
    assert got == {(1, 0): (1, 0, True), (1, 3): (1, 3, True), (2, 0): (1, 0, False), (3, 0): (1, 0, False), (6, 0): (6, 0, True), (6, 1): (6, 0, False)}
    texts = {r["doc_id"]: r["text"] for r in line_dedup.cleaned(docs).collect()}
    assert texts == {1: rows[0][1], 2: "short", 3: "", 4: None, 5: "", 6: prose(40, 9)}


def test_substring_dedup_without_spaces_and_short_lines(spark):
    passage = "春天来了花园里的花都开了。孩子们在树下唱歌跳舞。老人坐在长椅上看书喝茶。"
    thai = "สวัสดีครับยินดีต้อนรับสู่ประเทศไทย"
    rows = [(1, "第一篇文章自己的开头。" + passage + "第一篇的结尾。"), (2, "第二篇不同的开头文字。" + passage + "另一个结尾。"), (3, thai + "\nsource one"), (4, "own\n" + thai), (5, "Read more\nSkip it. Yes. No.\nfirst"), (6, "second\nread  More\nSkip it. Yes. No."), (7, "x/" * 200 + ". Mine here."), (8, "Other. " + "x/" * 200 + ". Too.")]
    rows += [(9, "Read more of it. Yes. Own end"), (10, "a read more b")]
    got = {r["doc_id"]: r["text"] for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] == "第二篇不同的开头文字。另一个结尾。" and got[4] == "own\n" and got[6] == "second\n" and got[8] == "Other. Too."
    assert all(got[d] == t for d, t in rows if d in (1, 3, 5, 7, 9, 10))


def line_brute_force(rows):
    """{row: first row of its component} of one-line texts, by all pairs."""
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for _, t in rows]
    return linked_components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])


@pytest.mark.parametrize("one_bucket", [False, True])
def test_line_dedup_compares_whole_buckets(spark, monkeypatch, one_bucket):
    if one_bucket:  # the begin of a line is its only shingle
        own = line_dedup.shingled
        monkeypatch.setattr(line_dedup, "shingled", lambda *a: own(*a).where("at = 1"))
        monkeypatch.setattr(line_dedup, "BLOCK", 8)
        monkeypatch.setattr(line_dedup, "PIVOTS", 2)
    rng = random.Random(4)
    paths = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=90)) for _ in range(40)]
    rows = list(enumerate("https://example.org/archive/" + p + end for end in ("a", "b") for p in paths))
    rows += [(len(rows) + k, "https://example.org/archive/" + p[: 20 + k]) for k, p in enumerate(paths)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["kept_doc_id"] for r in line_dedup.fuzzy_lines(docs).collect()}
    assert [got[k] for k, _ in rows] == line_brute_force(rows)


def test_line_dedup_of_odd_lines(spark):
    rows = [(1, "春 天      来"), (2, "春 天        来"), (3, "夏天          "), (4, "=" * 30 + "\n" + "=" * 120), (5, "\t" * 12), (6, "x" * 100_000), (7, "x" * 100_000 + "\r"), (8, "añb çd éf gh ij kl mn\nanb cd ef gh ij kl mn"), (8, "añb çd éf gh ij kl mn\nanb cd ef gh ij kl mn")]
    docs = spark.createDataFrame([(d, t, "g", 1) for d, t in rows], "doc_id long, text string, _gone string, gone int")
    got = {(r["doc_id"], r["line"]): (r["kept_doc_id"], r["kept_line"]) for r in line_dedup.fuzzy_lines(docs, 1).collect()}
    assert got[2, 0] == (1, 0) and got[4, 1] == (4, 0) and got[7, 0] == (6, 0) and got[8, 0] == (8, 0) and got[8, 1] == (8, 1) and got[3, 0] == (3, 0)
    out = line_dedup.cleaned(docs)
    assert out.columns == docs.columns and out.count() == len(rows) and {r["_gone"] for r in out.collect()} == {"g"}


def test_line_dedup_recall(spark):
    """Pairs of lines just over the threshold, by edits of characters and of words, against all pairs."""
    rng, rows = random.Random(12), []
    for k in range(150):
        line = prose(rng.randint(12, 60), 500 + k)
        chars = list(line)
        for _ in range(len(chars) // 50):
            chars[rng.randrange(len(chars))] = rng.choice("abcdefgh")
        rows += [line, "".join(chars), edited(line, max(1, len(line.split()) // 12), k)]
    rows = list(enumerate(rows))
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = {r["doc_id"]: r["kept_doc_id"] for r in line_dedup.fuzzy_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = linked_components(len(rows), links)
    assert all(want[k] == want[got[k]] for k, _ in rows)  # nothing is linked that should not be
    assert len(links) > 150 and sum(got[a] == got[b] for a, b in links) >= 0.95 * len(links)


@pytest.mark.parametrize("run", [near_dedup.near_duplicates, exact_dedup.dedup, line_dedup.fuzzy_lines, substring_dedup.dedup, lambda d: packing.pack(d, vocabulary("byte_bpe_50k.json"))])
def test_empty_tables(empty, run):
    assert run(empty).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate([prose(80, 20), prose(80, 20), edited(prose(80, 20), 1, 4), None, "12", *[prose(60, 30 + k) for k in range(6)]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert name == "packing" or out.columns == docs.columns
        docs = out
    assert docs.count() > 0


def substring_brute_force(rows, rule):
    """Texts without their repeats by plain loops over all earlier units, in order of doc_id."""
    out, held = {}, set()
    for d, text in sorted(rows, key=lambda r: r[0]):
        own = substring_dedup.units(text or "", rule)
        out[d] = text if text is None else substring_dedup.without(text, substring_dedup.removed(text, held, rule))
        held |= {x for u in own for x in u[4:] if x}
    return out


@pytest.mark.parametrize("rule", [substring_dedup.Rule(), substring_dedup.Rule(1, 1, 1)])
def test_substring_dedup_equals_plain_loops(spark, rule):
    rng = random.Random(8)
    sentences = [prose(rng.randint(1, 25), 300 + k).capitalize() + "." for k in range(40)]
    rows = [(k, rng.choice(" \n").join(rng.choice(sentences) for _ in range(rng.randint(0, 12)))) for k in range(80)] + [(200, None), (201, "x" * 300_000 + ". " + sentences[0])]
    docs = spark.createDataFrame([(d, t, "a", 1) for d, t in rows], "doc_id long, text string, later string, _doc_id long").repartition(4)
    want = substring_brute_force(rows, rule)
    assert {r["doc_id"]: r["text"] for r in substring_dedup.dedup(docs, rule).collect()} == want
    whole = substring_dedup.cleaned(docs, rule)
    assert whole.columns == docs.columns and {r["doc_id"]: (r["text"], r["later"], r["_doc_id"]) for r in whole.collect()} == {d: (t, "a", 1) for d, t in want.items()}


def test_substring_rule_without_cuts_removes_every_repeat(spark):
    docs = spark.createDataFrame([(1, "A b. Long own text. Yes."), (2, "My own. A b. Yes. Other.")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in substring_dedup.dedup(docs, substring_dedup.Rule(1, 1, 1)).collect()}
    assert got == {1: "A b. Long own text. Yes.", 2: "My own. Other."}


def test_language_rejects_noise_and_keeps_short_texts(spark):
    rng = random.Random(6)
    sounds = {"xa": ["the", "and", "ing", "tion", "er"], "yb": ["der", "und", "sch", "keit", "ein"], "zc": ["que", "les", "eau", "ment", "oir"]}
    text = lambda lang, n: " ".join("".join(rng.choices(sounds[lang], k=2)) for _ in range(n))
    rows = [(k, text(lang, rng.randint(4, 80)), lang, "n") for k in range(900) for lang in [list(sounds)[k % 3]]]
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(200)) for _ in range(20)] + ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(80)) for _ in range(20)]
    rows += [(1000 + k, t, None, "n") for k, t in enumerate(noise)] + [(2000 + k, text(lang, 4), None, "n") for k, lang in enumerate(list(sounds) * 10)]
    rows += [(3000, "½ ²", None, "n"), (3001, "①", None, "n"), (3002, None, None, "n"), (3003, "", None, "n"), (3004, text("xa", 30_000), None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out string")
    net = language.fit(docs)
    out = language.accepted(docs, net)
    kept = {r["doc_id"] for r in out.collect()}
    assert out.columns == docs.columns and not any(1000 <= k < 1040 for k in kept) and not any(3000 <= k < 3004 for k in kept) and 3004 in kept
    assert sum(k < 1000 for k in kept) >= 890 and sum(2000 <= k < 2030 for k in kept) >= 28
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, net).collect()}
    assert got[3000] == got[3001] == got[3002] == got[3003] == "und" and got[3004] == "xa"


def test_language_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k % 50, "the and " * (k + 1), "xa") for k in range(200)], "doc_id long, text string, lang string")
    assert language.fit(docs, 20).classes == ["xa"] and language.fit(docs, 20).dense.shape[1] == 2


def test_language_sample_is_bounded_when_an_id_repeats(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "train", lambda texts, langs: seen.append(texts))
    language.fit(spark.createDataFrame([(1, f"the and {'x' * (k % 7)}", "xa") for k in range(3000)] + [(None, "the", "xa")] * 50, "doc_id long, text string, lang string"), 20)
    language.fit(spark.createDataFrame([(1, "the same", "xa")] * 3000, "doc_id long, text string, lang string"), 20)
    assert [len(t) for t in seen] == [20, 20]


def test_line_sketches_by_words_equal_those_by_bytes(spark):
    """Each way of cutting a line's shingles gives what trying every byte gives; most lines are not tried at every byte."""
    rng = random.Random(3)
    words = ["a", "of", "naïve", "été", "word", "x" * 11, "y" * 12, "z" * 13, "é" * 7, "https://example.org/" + "q" * 20, "übergrößenträger"]
    lines = [" ".join(rng.choices(words[: rng.choice([5, 7, 11])], k=rng.randint(1, 14))) for _ in range(300)] + ["春天 来了 abc", "", "w" * 3000, "a b c d e f g h"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "k int, norm string").withColumn("kind", line_dedup.kind())
    found = {0: line_dedup.worded, 1: line_dedup.long_worded, 2: line_dedup.shingled}
    own = lambda d: sorted((r["k"], r["h"], r["at"] == 1) for r in d.collect())
    kinds = {r["kind"]: r["count"] for r in rows.groupBy("kind").count().collect()}
    assert kinds[0] > 50 and kinds[1] > 50 and kinds[2] == 1
    for kind, cut in found.items():
        some = rows.where(f"kind = {kind}")
        assert own(cut(some, "k")) == own(line_dedup.shingled(some, "k"))


def test_line_bitmaps_leave_out_unlike_lines(spark):
    """No similar pair is left out, and pairs well under the threshold are, however full the bitmaps are."""
    rng, texts = random.Random(8), []
    for k in range(60):
        base = prose(55, 900 + k)
        texts += [base, edited(base, 2, k), edited(base, 6, k)]
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in texts]
    near = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    pairs = [(3 * k, 3 * k + j) for k in range(60) for j in (1, 2)]
    rows = spark.createDataFrame(list(enumerate(texts)), "rep long, norm string")
    got = {(r["a"], r["b"]) for r in line_dedup._possible(spark.createDataFrame(pairs, "a long, b long"), line_dedup._bitmaps(rows)).collect()}
    assert {p for p in pairs if near(*p) >= 0.8} <= got
    under = [p for p in pairs if near(*p) < 0.74]
    assert len(under) > 30 and sum(p in got for p in under) <= len(under) // 20
