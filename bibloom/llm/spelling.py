"""Spelling variants: words one edit apart, by a positional q-gram inverted index with count filter, and the forms they lead to.

The index has two levels. Words are dealt by long positional grams, the halves of a word: one edit leaves the first or the
last half of the shorter word as it was (prefix at its place from the left, suffix from the right), so that every pair
meets in one key. Keys that hold more than `most` words are refined: their free middle is halved again, until it is one
letter. Within a key, the postings of short grams (two letters, with both ends marked) are merged by a heap under length
and position limits: a list's words have the query's length and place, or one letter more and the same or next place. A
word is a candidate when it meets the one-edit overlap bound, max(length) + q - 1 - q common grams, less those of the
shared half; lists are skipped ahead where the bound can no longer be met. Candidates are verified letter by letter. A pair
that shares both halves is taken in the prefix's key alone, so that every pair comes once.

Runs of letters [A-Za-z\\u00C0-\\u00FF]+ are cut from whole texts in generated code. Null texts hold none, a null doc_id is
written as an empty string in front of the colon, repeated rows and ids count each, empty tables give no rows, other columns
are not read. Of near words with equal counts the first in code-point order is the form. A single long run is one word.
"""

from __future__ import annotations

import itertools
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibloom.llm.common import partitions, written

Q = 2
#: Least code points and occurrences of a word.
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: Words of one key above which its free middle is halved.
MOST = 2000
#: How much more often a form occurs than the word it stands for.
TIMES = 5
MISSPELT = 199
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """(doc_id, run) of every run of at least `least` letters, A-Z lower-cased."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([A-Za-zÀ-ÿ]{%d,})" % least), F.lit(1))
    return docs.select("doc_id", F.explode(found).alias("run")).select("doc_id", F.translate("run", _UPPER, _LOWER).alias("run"))


def altered(doc_id: Column, run: Column) -> Column:
    """The run, or the run without one letter where 199 divides the checksum of document and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(h % MISSPELT == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def counted(docs: DataFrame) -> DataFrame:
    """(word, n): the words that occur often enough, counted over all documents."""
    words = runs(docs).select(altered(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _keyed(words: DataFrame) -> DataFrame:
    """(m, p, s, head, tail, word, n): the halves of each word as one of length m, and of length m + 1."""
    length = F.length("word")
    classes = words.withColumn("m", F.explode(F.array_compact(F.array(length, F.when(length > LEAST_LENGTH, length - 1)))))
    return _split(classes.withColumns({"p": F.lit(0), "s": F.lit(0)}))


def _split(rows: DataFrame) -> DataFrame:
    """Halves the free middle of each key: its first half joins the head, or its last half the tail."""
    first = F.floor((F.col("m") - F.col("p") - F.col("s")) / 2).cast("int")
    side = F.explode(F.array(F.struct((F.col("p") + first).alias("p"), F.col("s").alias("s")), F.struct(F.col("p").alias("p"), (F.col("m") - F.col("p") - first).alias("s")))).alias("side")
    cut = rows.select("m", side, "word", "n").select("m", "side.p", "side.s", "word", "n")
    return cut.select("m", "p", "s", F.substring(F.col("word"), F.lit(1), F.col("p")).alias("head"), F.when(F.col("s") == 0, "").otherwise(F.substring(F.col("word"), -F.col("s"), F.col("s"))).alias("tail"), "word", "n")


_KEY = ("m", "p", "s", "head", "tail")


def dealt(words: DataFrame, most: int = MOST) -> DataFrame:
    """All words under their keys; no key whose free middle has two letters or more holds over `most` words.

    Counts are aggregated before they are shuffled; a level is written before the next one reads it.
    """
    rows, done = written(_keyed(words), "keys"), []
    while True:
        # a key without words of length m has nothing to look up
        sizes = rows.groupBy(*_KEY).agg(F.count("*").alias("words"), F.count_if(F.length("word") == F.col("m")).alias("own")).where("words > 1 and own > 0")
        sized = rows.join(sizes.withColumn("hot", (F.col("words") > most) & (F.col("m") - F.col("p") - F.col("s") > 1)).select(*_KEY, "hot"), list(_KEY))
        sized = written(sized.select(*_KEY, "word", "n", "hot"), "keys")
        done.append(sized.where("not hot").drop("hot"))
        if sized.where("hot").isEmpty():
            break
        rows = written(_split(sized.where("hot")), "keys")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def merged(lists: list[tuple[list[int], int]], need: int) -> Iterator[int]:
    """The ids that at least `need` of the sorted lists hold, each from its start on, by a heap; skips what cannot reach it."""
    heap = [(held[at], k, at) for k, (held, at) in enumerate(lists) if at < len(held)]
    heapify(heap)
    while len(heap) >= need:
        top, same = heap[0][0], []
        while heap and heap[0][0] == top:
            same.append(heappop(heap))
        if len(same) >= need:
            yield top
            to = top + 1
        else:
            while heap and len(same) < need - 1:
                same.append(heappop(heap))
            if not heap:
                return
            to = heap[0][0]
        for _, k, at in same:
            held = lists[k][0]
            at = bisect_left(held, to, at + 1) if held[at] < to else at
            if at < len(held):
                heap.append((held[at], k, at))
        heapify(heap)


def one_edit(a: str, b: str) -> bool:
    """Exactly one letter replaced (equal lengths), or one inserted into a."""
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :])


def near_pairs(m: int, p: int, s: int, words: list[str]) -> Iterator[tuple[int, int]]:
    """Places of the near words of one key: a of length m, b of length m (after a) or m + 1."""
    index: dict[int, dict[tuple[int, str], list[int]]] = {m: defaultdict(list), m + 1: defaultdict(list)}
    grams = []
    for i, w in enumerate(words):
        marked = "\x01" + w + "\x02"
        # grams inside the head or the tail are common to all and need no postings
        own = [(at, marked[at : at + Q]) for at in range(p, len(w) - s + 1)]
        grams.append(own)
        for g in own:
            index[len(w)][g].append(i)
    own, longer = index[m], index[m + 1]
    for i, w in enumerate(words):
        if len(w) != m:
            continue
        need = len(grams[i]) - Q
        if need > 0:
            found = merged([(own[g], bisect_left(own[g], i + 1)) for g in grams[i]], need)
        else:
            found = (j for j in range(i + 1, len(words)) if len(words[j]) == m)
        for j in found:
            if one_edit(w, words[j]):
                yield i, j
        if longer:
            need = len(grams[i]) - (Q - 1)
            lists = [(longer[g], 0) for at, x in grams[i] for g in ((at, x), (at + 1, x)) if g in longer]
            for j in merged(lists, need) if need > 0 else (j for j in range(len(words)) if len(words[j]) > m):
                b = words[j]
                if one_edit(w, b) and not (s and w[: m - s] == b[: m - s]):
                    yield i, j


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n_near, best) of every word with a near word in a key: partial counts, and the best near word with its count."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
    out: list[tuple[str, int, int, str]] = []
    for (m, p, s, _, _), group in itertools.groupby(rows, key=lambda r: r[:5]):
        held = [r[5:] for r in group]
        count, best = [0] * len(held), [None] * len(held)
        for i, j in near_pairs(m, p, s, [w for w, _ in held]):
            for x, y in ((i, j), (j, i)):
                count[x] += 1
                this = (-held[y][1], held[y][0])
                if best[x] is None or this < best[x]:
                    best[x] = this
        out += [(held[i][0], c, *best[i]) for i, c in enumerate(count) if c]
        if len(out) > 20_000:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def _batch(rows: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "c", "minus", "near"])


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n_near, near, near_n) of the words that have near words: how many, and the one of largest n."""
    tasks = partitions(words.sparkSession)
    sorted_keys = dealt(words, most).repartition(tasks, *_KEY).sortWithinPartitions(*_KEY)
    found = sorted_keys.mapInArrow(_links, "word string, c long, minus long, near string")
    best = found.groupBy("word").agg(F.sum("c").alias("n_near"), F.min(F.struct("minus", "near")).alias("b"))
    return best.select("word", "n_near", F.col("b.near").alias("near"), (-F.col("b.minus")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of each chain, by pointer jumping. Counts grow along a chain, so it ends."""
    up = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        over = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = written(up.join(over, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        up = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return up


def variants(docs: DataFrame, most: int = MOST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of the documents."""
    words = written(counted(docs), "words")
    near = near_words(words, most)
    stands = F.col("near_n") >= TIMES * F.col("n")
    formed = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(stands, F.col("near")).alias("form"), F.when(stands, F.col("near_n")).alias("form_n"))
    formed = written(formed, "forms")
    ends = roots(formed.where("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
