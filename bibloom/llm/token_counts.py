"""Token counts through a digest cache.

The key of a count is the SHA-256 of the content and a digest of the tokenizer file and its library's version, so a changed
tokenizer never meets old counts. Content is normalised only by taking null as empty: any further change could change its count. Rows are
joined to the stored counts, one row of each distinct missing content is encoded, and its count is appended.

Empty texts have no tokens. Repeated rows share one encoding, null ids stay null. Very long texts are encoded whole. An
empty table appends nothing. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from importlib.metadata import version
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibloom.llm.common import shared_dir, sliced, texts_of, written

LIMIT = 4096
CACHE = "content binary, tokenizer string, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file and its library."""
    suffix = Path(path).suffix
    library = f"{suffix} {version('tokenizers' if suffix == '.json' else 'sentencepiece')}"
    return hashlib.sha256(library.encode() + b"\0" + Path(path).read_bytes()).hexdigest()


class _Counts(dict):
    """Counts of words, encoded when first met; bounded by starting anew."""

    MOST = 500_000

    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = n = self.count(word)
        return n


def sentencepiece_counter(path: str):
    """A function text -> number of pieces of the whole text.

    Where the model has an identity normaliser, keeps white space and has no piece that continues after an inner space
    marker, no merge crosses from a word to the next space, and the counts of words (each with the gap before it) add
    up to that of the text. Any other model encodes whole texts.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    whole = lambda t: len(model.encode(t))
    if not separable(path, model):
        return whole
    counts = _Counts(whole)

    def count(text: str) -> int:
        if text[:1] == " " or text[-1:] == " " or "  " in text or "▁" in text or "\0" in text:
            return whole(text)
        return sum(map(counts.__getitem__, text.split(" "))) if text else 0

    return count


def separable(path: str, model) -> bool:
    from bibloom.llm.sentencepiece_backend import parse_model

    spec = parse_model(Path(path).read_bytes())
    inner = any("▁" in p.lstrip("▁") for p, _, _ in spec["pieces"])
    user = any(kind == 4 for _, _, kind in spec["pieces"])
    return spec["normalizer"] == "identity" and spec["add_dummy_prefix"] and not spec["remove_extra_whitespaces"] and spec["escape_whitespaces"] and not inner and not user


def json_counter(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    return lambda t: len(own.encode(t, add_special_tokens=False).ids)


_counters: dict[str, object] = {}


def counter(path: str):
    if path not in _counters:
        _counters[path] = (json_counter if path.endswith(".json") else sentencepiece_counter)(path)
    return _counters[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in sliced(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array([count(t) for t in texts_of(batch.column("text"))], pa.int64())], names=["content", "n_tokens"])

    return run


def new_cache(spark: SparkSession) -> str:
    """The path of an empty cache in the shared folder."""
    path = f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    spark.createDataFrame([], CACHE).write.parquet(path)
    return path


def counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs; misses are encoded once and appended to the cache."""
    spark = docs.sparkSession
    cache, version = cache or new_cache(spark), tokenizer_version(tokenizer)
    text = F.coalesce("text", F.lit(""))
    content = F.unhex(F.sha2(text.cast("binary"), 256)).alias("content")
    stored = lambda: spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version).select("content", "n_tokens")
    rows = written(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), content), "contents")
    id_ = F.coalesce("doc_id", F.lit(-1)).alias("id")
    misses = written(rows.join(stored(), "content", "left_anti").groupBy("content").agg(F.min(id_).alias("id")), "misses")
    found = docs.select(id_, content, text.alias("text")).join(misses.hint("shuffle_hash"), ["id", "content"], "left_semi")
    made = found.select("content", "text").mapInArrow(_encode(tokenizer), "content binary, n_tokens long").dropDuplicates(["content"])
    made.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    out = rows.join(stored(), "content")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
