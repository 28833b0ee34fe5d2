"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation estimates how far to trust each.

Every document gets one vote of each rule: 1 (good), -1 (bad) or 0 (abstains). A good or bad document is the hidden class;
a rule that votes is right with accuracies of its own, whatever the others say. The model is fitted on all documents that pass the
base check (the others are decided), but only through the counts of their vote patterns, which number 3 ** len(RULES) at most, however many documents there are.
The posterior probability that a document is good replaces a filter that all rules must pass: a rule that often blames
documents the others vouch for loses its weight. Accuracies are of two kinds, on good and on bad documents, as a rule made
for one fault passes every document with another.

Texts are measured whole. Words are `[^\\x20\\x09-\\x0D]+`, compared as they are. Null texts count as empty: no words, so the
base check fails and they are not kept. A text of one very long word or line is measured as any other. Repeated rows and
ids vote once a row, null ids stay null. Equal vote patterns have equal posteriors; a posterior of exactly the threshold is
kept. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibloom.llm.common import bounded_batches, release, sliced, texts_of, written

SYMBOLS = "#*$%&|<>"
SEPARATORS = " \t\n\x0b\x0c\r"
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Endings of a finished line (fixed values).
ENDINGS = (".", "!", "?", "…", "\"", "'", "”", "’", "»", ")", ":", ";", "。", "！", "？", "।", "؟")
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_ended long, n_distinct long, n_alphabetic long, n_plain long, longest long"


def repeated_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """How many of the words stand in a window of `width` words that the text holds twice or more. Exact."""
    windows = len(ids) - width + 1
    if windows < 2:
        return 0
    key, left = ids.astype(np.int64), width
    size = int(key.max()) + 1
    out, span = key[:windows], size
    for k in range(1, left):
        if span * size >= 1 << 62:  # rank what is joined so far, so that the next word fits
            out = np.unique(out, return_inverse=True)[1].astype(np.int64)
            span = int(out.max()) + 1
        out, span = out * size + key[k : k + windows], span * size
    _, inverse, count = np.unique(out, return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[inverse] > 1)
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + width, -1)
    return int((np.cumsum(cover) > 0).sum())


def measured(text: str) -> tuple[int, ...]:
    """The MEASURES of one whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes part at \\x20 and \\x09-\\x0D, and nowhere else
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    kinds = np.bincount(ids, minlength=len(known))
    plain = np.fromiter((_PLAIN(w) is not None for w in known), bool, len(known))
    letter = np.fromiter((p or _LETTER(w) is not None for w, p in zip(known, plain)), bool, len(known))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    ended = sum(line.rstrip().endswith(_ENDINGS) for line in lines)
    longest = max(map(len, known), default=0)
    if longest > 40:  # code points, where bytes leave it open
        longest = max(len(w.decode("utf-8", "surrogatepass")) for w in known if len(w) > 40)
    return (
        len(words), len(text) - sum(map(text.count, SEPARATORS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ids),
        len(lines), ended, len(known), int(kinds[letter].sum()), int(kinds[plain].sum()), longest,
    )


_ENDINGS = tuple(e.encode() for e in ENDINGS)
#: In UTF-8; characters beyond ASCII count as letters.
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]").search
_PLAIN = re.compile(rb"[\"'(]?[A-Za-z\x80-\xff]+(?:['-][A-Za-z\x80-\xff]+)*[\"')]*[.,;:!?]*[\"')]*").fullmatch


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, MEASURES) of every document."""
    bounded_batches(docs.sparkSession)
    names = [m.split(" ")[0] for m in MEASURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            found = np.array([measured(t) for t in texts_of(batch.column("text"))], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.ascontiguousarray(c)) for c in found.T)], names=["doc_id", *names])
        release()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {MEASURES}")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("byte")


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))


def rules() -> dict[str, Column]:
    """The votes, from published heuristics on web text; between the two limits a rule abstains."""
    some = F.col("n_words") >= LEAST_WORDS
    return {
        "length": _vote(F.col("n_words").between(50, 100_000), F.col("n_words") < LEAST_WORDS),
        "word_length": _vote(_share("word_chars", "n_words").between(3, 10), some & ((_share("word_chars", "n_words") < 2.5) | (_share("word_chars", "n_words") > 15))),
        "symbols": _vote(some & (_share("n_symbols", "n_words") <= 0.03), _share("n_symbols", "n_words") > 0.1),
        "lines": _vote((F.col("n_lines") > 1) & (F.col("n_dup_lines") == 0), _share("n_dup_lines", "n_lines") > 0.3),
        "repeats": _vote(some & (_share("n_repeat_words", "n_words") <= 0.05), _share("n_repeat_words", "n_words") > 0.15),
        "endings": _vote(some & (_share("n_ended", "n_lines") >= 0.5), (F.col("n_lines") >= 5) & (_share("n_ended", "n_lines") < 0.1)),
        "variety": _vote(some & (_share("n_distinct", "n_words") >= 0.3), (F.col("n_words") >= 50) & (F.col("n_words") < 2000) & (_share("n_distinct", "n_words") < 0.1)),
        "alphabetic": _vote(some & (_share("n_alphabetic", "n_words") >= 0.9), some & (_share("n_alphabetic", "n_words") < 0.8)),
        "plain": _vote(some & (_share("n_plain", "n_words") >= 0.8), some & (_share("n_plain", "n_words") < 0.6)),
        "longest": _vote(some & (F.col("longest") <= 30), F.col("longest") > 80),
    }


RULES = ("length", "word_length", "symbols", "lines", "repeats", "endings", "variety", "alphabetic", "plain", "longest")
#: Bounds of what a rule gets right among good and among bad documents that it votes on, and of the share of good ones.
RIGHT_GOOD, RIGHT_BAD, PRIOR = (0.5, 0.999), (0.001, 0.999), (0.05, 0.95)


@dataclass
class Votes:
    """The fitted model: share of good documents, each rule's accuracy on good and on bad ones, and the rounds that took."""

    prior: float
    on_good: np.ndarray
    on_bad: np.ndarray
    rounds: int

    def weights(self) -> tuple[float, np.ndarray, np.ndarray]:
        """Log odds of being good: of a document without votes, and what a good and a bad vote of each rule add."""
        return float(np.log(self.prior / (1 - self.prior))), np.log(self.on_good / (1 - self.on_bad)), np.log((1 - self.on_good) / self.on_bad)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 1000, tolerance: float = 1e-10, strength: float = 4.0) -> Votes:
    """Fits share and accuracies to vote patterns (rows of -1, 0, 1) and how many documents show each.

    Starts from rules that rarely blame a good document and miss most bad ones, each being made for one fault; as many
    imaginary votes as `strength` hold them there where few documents vote. An abstention tells nothing.
    """
    k = patterns.shape[1]
    start = Votes(0.8, np.full(k, 0.98), np.full(k, 0.2), 0)
    model, counts = start, counts.astype(float)
    yes, no = (patterns > 0).astype(float), (patterns < 0).astype(float)
    for done in range(1, rounds + 1):
        base, plus, minus = model.weights()
        good = counts / (1 + np.exp(-(base + yes @ plus + no @ minus)))
        bad = counts - good
        on_good = np.clip((good @ yes + start.on_good * strength) / (good @ (yes + no) + strength), *RIGHT_GOOD)
        on_bad = np.clip((bad @ no + start.on_bad * strength) / (bad @ (yes + no) + strength), *RIGHT_BAD)
        on_bad = np.maximum(on_bad, 1 - on_good)  # no rule speaks against itself, so that the classes cannot change places
        prior = float(np.clip((good.sum() + start.prior * strength) / (counts.sum() + strength), *PRIOR))
        moved = max(abs(prior - model.prior), float(np.abs(on_good - model.on_good).max()), float(np.abs(on_bad - model.on_bad).max()))
        model = Votes(prior, on_good, on_bad, done)
        if moved < tolerance:
            break
    return model


def voted(measured_docs: DataFrame) -> DataFrame:
    """measured documents with votes: an array of one vote a rule, in the order of RULES."""
    own = rules()
    return measured_docs.withColumn("votes", F.array(*[own[r] for r in RULES]))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def fit(votes: DataFrame) -> Votes:
    """The model over all documents that pass the base check, from the counts of their vote patterns (3 ** len(RULES) rows at most)."""
    rows = sorted((tuple(r["votes"]), r["c"]) for r in votes.where(~base_failed()).groupBy("votes").agg(F.count("*").alias("c")).collect())
    return expectation_maximisation(np.array([v for v, _ in rows], float).reshape(-1, len(RULES)), np.array([c for _, c in rows], float))


def judged(votes: DataFrame, model: Votes, threshold: float = 0.5) -> DataFrame:
    """voted documents with base_failed, posterior (of being good) and kept."""
    base, plus, minus = model.weights()
    odds = F.lit(base)
    for k, (yes, no) in enumerate(zip(plus, minus)):
        vote = F.col("votes")[k]
        odds = odds + F.when(vote > 0, float(yes)).when(vote < 0, float(no)).otherwise(0.0)
    out = votes.withColumn("base_failed", base_failed()).withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def assessed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior, votes)."""
    votes = written(voted(measures(docs)), "votes")
    out = judged(votes, fit(votes))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior", "votes")


def filtered(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; rows of one doc_id stay if any of them does."""
    kept = assessed(docs).where("kept").select("doc_id").distinct()
    return docs.join(kept.hint("merge"), "doc_id", "left_semi").select(*docs.columns)
