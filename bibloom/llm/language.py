"""Language identification with a byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed-length windows in steps of STRIDE bytes, each filter's
maximum over a window feeds a softmax. The network is trained in numpy on a bounded sample of labelled rows (SAMPLE
rows, those with the least hash of doc_id) and applied to all windows of every text; a text's score is the softmax of
the mean of its windows' logits, weighted by their bytes. One more output learns noise, windows whose bytes are in
random order; it takes no part in the scores of languages and serves to reject texts.

Null text and text without a letter give `und` with score 0. Without any labelled row everything is `und`. Only text
is an input of a prediction. Repeated rows get equal results. Very long texts are read whole. An empty table gives no
rows. Other columns, whatever their names, are not read by `predict` and stay as they are in `accepted`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibloom.llm.common import bounded_batches, release, sliced, texts_of

#: Labelled rows that the network is fitted on, at most; windows taken from each.
SAMPLE, CROPS = 2000, 4
WINDOW, STRIDE, EMBED, WIDTHS, FILTERS = 128, 2, 8, (2, 4, 6), 16
EPOCHS, BATCH, RATE = 6, 64, 0.004
UNDETERMINED = "und"
#: Share of the windows that are learnt a second time with their bytes in random order, as noise.
NOISE = 0.25
#: By how much the logit of noise must lead for a text to be rejected, so that short texts stay.
MARGIN = 1.0


def _cut(data: np.ndarray) -> np.ndarray:
    """Windows of WINDOW bytes, the last one filled with zeros."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = data
    return out.reshape(n, WINDOW)


class Network:
    """Weights: embedding (256, EMBED), filters (widest * EMBED, filters; zero beyond a filter's width), dense layer."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes, wide = classes, max(WIDTHS)
        self.embedding = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.mask = np.concatenate([np.repeat(np.arange(wide) < w, EMBED)[:, None].repeat(FILTERS, 1) for w in WIDTHS], 1).astype(np.float32)
        self.filters = (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(self.mask.shape[1], np.float32)
        self.dense = rng.normal(0, 0.1, (self.mask.shape[1], len(classes) + 1)).astype(np.float32)  # the last one: noise
        self.offset = np.zeros(len(classes) + 1, np.float32)

    def _columns(self, windows: np.ndarray) -> np.ndarray:
        """(n * positions, widest * EMBED): the embedded bytes that each filter position sees."""
        e = self.embedding[windows].reshape(len(windows), WINDOW * EMBED)
        view = np.lib.stride_tricks.sliding_window_view(e, max(WIDTHS) * EMBED, axis=1)[:, :: STRIDE * EMBED]
        return view.reshape(-1, max(WIDTHS) * EMBED)

    def pooled(self, windows: np.ndarray):
        columns = self._columns(windows)
        maps = (columns @ self.filters).reshape(len(windows), -1, self.filters.shape[1])
        return columns, maps, maps.max(axis=1)

    def logits(self, windows: np.ndarray) -> np.ndarray:
        return np.concatenate([np.maximum(self.pooled(windows[i : i + 128])[2] + self.bias, 0) @ self.dense + self.offset for i in range(0, len(windows), 128)])

    def fit(self, windows: np.ndarray, labels: np.ndarray, seed: int = 11) -> Network:
        rng, step = np.random.default_rng(seed), 0
        names = ("embedding", "filters", "bias", "dense", "offset")
        first, second = ({k: np.zeros_like(getattr(self, k)) for k in names} for _ in range(2))
        for _ in range(EPOCHS):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                x, y = windows[pick], labels[pick]
                columns, maps, top = self.pooled(x)
                hidden = np.maximum(top + self.bias, 0)
                z = hidden @ self.dense + self.offset
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(y)), y] -= 1
                p /= len(y)
                g_hidden = (p @ self.dense.T) * (hidden > 0)
                where = maps.argmax(axis=1)
                g_maps = np.zeros_like(maps)
                np.put_along_axis(g_maps, where[:, None, :], g_hidden[:, None, :], axis=1)
                flat = g_maps.reshape(-1, maps.shape[2])
                g_columns = (flat @ self.filters.T).reshape(len(x), maps.shape[1], max(WIDTHS), EMBED)
                g_embed = np.zeros_like(self.embedding)
                at_byte = np.arange(maps.shape[1])[:, None] * STRIDE + np.arange(max(WIDTHS))
                np.add.at(g_embed, x[:, at_byte].ravel(), g_columns.reshape(-1, EMBED))
                grads = {"embedding": g_embed, "filters": (columns.T @ flat) * self.mask, "bias": g_hidden.sum(0), "dense": hidden.T @ p, "offset": p.sum(0)}
                step += 1
                for k in names:
                    first[k] = 0.9 * first[k] + 0.1 * grads[k]
                    second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                    move = RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, k, (getattr(self, k) - move).astype(np.float32))
        return self

    def scores(self, texts: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """The places of texts with a letter, their probabilities of the classes, and whether noise leads all by MARGIN."""
        some = [i for i, t in enumerate(texts) if any(c.isalpha() for c in t)]
        if not some or not self.classes:
            return [], np.zeros((0, len(self.classes))), np.zeros(0, bool)
        cut = [_cut(np.frombuffer(texts[i].encode("utf-8", "surrogatepass"), np.uint8)) for i in some]
        windows = np.concatenate(cut)
        weight = np.maximum((windows != 0).sum(1), 1).astype(np.float32)[:, None]
        start = np.concatenate(([0], np.cumsum([len(c) for c in cut])[:-1]))
        z = np.add.reduceat(self.logits(windows) * weight, start) / np.add.reduceat(weight, start)
        p = np.exp(z[:, :-1] - z[:, :-1].max(1, keepdims=True))
        return some, p / p.sum(1, keepdims=True), z[:, -1] > z[:, :-1].max(1) + MARGIN

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        for i, row in zip(*self.scores(texts)[:2]):
            k = int(row.argmax())
            names[i], scores[i] = self.classes[k], min(1.0, float(row[k]))
        return names, scores

    def accepts(self, texts: list[str], least: float) -> list[bool]:
        """Whether a text is likelier of a language than noise, and its score that share of the way from chance to certainty."""
        out, chance = [False] * len(texts), 1 / max(1, len(self.classes))
        for i, row, noise in zip(*self.scores(texts)):
            out[i] = not noise and bool(row.max() >= chance + least * (1 - chance))
        return out


def train(texts: list[str], langs: list[str], seed: int = 3) -> Network:
    """A network fitted on windows cut at random places, some of them shortened so that short texts are known too."""
    rng, classes = np.random.default_rng(seed), sorted(set(langs))
    windows, labels = [], []
    for text, lang in zip(texts, langs):
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        for _ in range(min(CROPS, 1 + len(data) // 32)):
            at = int(rng.integers(0, max(1, len(data) - WINDOW + 1)))
            part = data[at : at + (WINDOW if rng.random() < 0.5 else int(rng.integers(8, WINDOW)))]
            windows.append(_cut(part)[0])
            labels.append(classes.index(lang))
            if rng.random() < NOISE:
                windows.append(_cut(rng.permutation(part))[0])
                labels.append(len(classes))
    net = Network(classes)
    return net.fit(np.array(windows), np.array(labels)) if windows and len(classes) else net


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Network:
    """A network from at most `sample` labelled rows that are not held out, those with the least hash of doc_id.

    Rows of one doc_id go by a hash of their text. The rows are ranked without their texts; only the texts of those chosen,
    `sample` rows however often an id or a whole row repeats, come to the driver.
    """
    rows = docs.where(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    order = ["h", "doc_id", "t"]
    ranked = rows.select(F.xxhash64("doc_id").alias("h"), "doc_id", F.xxhash64("text", "lang").alias("t"))
    least = ranked.orderBy(*order).limit(sample).distinct()
    mine = rows.select(F.xxhash64("doc_id").alias("h"), "doc_id", F.xxhash64("text", "lang").alias("t"), "lang", "text")
    chosen = mine.join(F.broadcast(least), order).orderBy(*order).limit(sample).collect()
    chosen = [(r["h"], r["doc_id"], r["lang"], r["text"]) for r in chosen]
    return train([r[3] for r in chosen], [r[2] for r in chosen])


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            names, scores = net.predict(texts_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, net: Network, least: float = 0.05) -> DataFrame:
    """The rows of docs, all columns as they were, whose text has a language: see Network.accepts."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            yield batch.filter(pa.array(net.accepts(texts_of(batch.column("text")), least), pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)
