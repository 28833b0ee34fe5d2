"""Scholarly indexes as a Python data source: one partition a request, answers as rows, a failing request as a row that says so.

A request is a search in one index, a work, a work's citers or references, or a DOI. Its cache key, address and parameters
are plain values. Answers come from a recorded log (a folder that Spark wrote, one subfolder a request) or over HTTP. A
year window is an option that goes into the requests, as the indexes filter by year themselves; the works are checked again
afterwards, where a year that nobody knows passes. (It is no pushed filter: Spark keeps a reader that filters were pushed
into for later queries on the same DataFrame.)
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from bibloom.operators.relevance import in_years
from bibloom.sources import payloads

SOURCES = ("openalex", "semanticscholar", "inspire")
# Addresses, most results of one request, and where an answer holds its items.
ADDRESS = {"openalex": "https://api.openalex.org/works", "semanticscholar": "https://api.semanticscholar.org/graph/v1/paper", "inspire": "https://inspirehep.net/api/literature"}
MOST = {"openalex": 200, "semanticscholar": 100, "inspire": 100}
ITEMS = {"openalex": ("results",), "semanticscholar": ("data",), "inspire": ("hits", "hits")}
KINDS = ("search", "work", "cited_by", "references", "doi")
TRIES, WAIT = 4, 1.0
SCHEMA = "request int, source string, kind string, asked string, place int, publication_year int, payload string, error string"


@dataclass(frozen=True)
class Request:
    """kind: one of KINDS; asked: the query, the index's id or the DOI; limit: most results wanted."""

    source: str
    kind: str
    asked: str
    limit: int = 50

    def key(self, low: int | None, high: int | None) -> str:
        """What the answer is recorded under; a year window is part of a search."""
        if self.kind == "search":
            return f"{self.source}:search:{self.asked}:{low}:{high}:{self.limit}"
        return f"{self.source}:{self.kind}:{self.asked.lower() if self.kind == 'doi' else self.asked}" + (f":{self.limit}" if self.kind == "cited_by" else "")

    def address(self, low: int | None, high: int | None) -> tuple[str, dict]:
        """(address, parameters) of the request over HTTP."""
        base, n, years = ADDRESS[self.source], min(self.limit, MOST[self.source]), low is not None or high is not None
        asked = urllib.parse.quote(self.asked, safe="")
        if self.kind == "search":
            if self.source == "openalex":
                return base, {"search": self.asked, "per-page": n} | ({"filter": f"publication_year:{low or 1800}-{high or 2100}"} if years else {})
            if self.source == "semanticscholar":
                return f"{base}/search", {"query": self.asked, "limit": n} | ({"year": f"{low or ''}-{high or ''}"} if years else {})
            return base, {"q": f"{self.asked} and de {low or 1800}->{high or 2100}" if years else self.asked, "size": n, "sort": "mostcited"}
        if self.kind == "work":
            return f"{base}/{asked}", {}
        if self.kind == "doi":
            return base, {"filter": f"doi:{self.asked}"}
        if self.kind == "cited_by":
            return (base, {"filter": f"cites:{self.asked}", "per-page": n}) if self.source == "openalex" else (f"{base}/{asked}/citations", {"limit": n})
        return f"{base}/{asked}", {"fields": "references"}


def folder(key: str) -> str:
    return "request=" + hashlib.sha256(key.encode()).hexdigest()[:24]


def recorded(root: str, request: Request, low: int | None, high: int | None) -> Iterator[str]:
    """The items of a recorded answer, in order. A request that was never recorded is an error, not an empty answer."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
    place = f"{path}/{folder(request.key(low, high))}"
    if system.get_file_info(place).type != fs.FileType.Directory:
        raise LookupError(f"no recorded answer for {request.key(low, high)}")
    rows = []
    for info in system.get_file_info(fs.FileSelector(place)):
        if info.base_name.startswith("part-"):
            with system.open_input_stream(info.path, compression=None) as f:
                rows += [json.loads(line) for line in f.read().decode("utf-8").splitlines()]
    yield from (r["payload"] for r in sorted(rows, key=lambda r: r["place"]) if r.get("payload") is not None)


def over_http(request: Request, low: int | None, high: int | None) -> Iterator[str]:
    """The items of an answer over HTTP; throttled and broken servers are asked again with growing pauses."""
    address, parameters = request.address(low, high)
    for attempt in range(TRIES):
        try:
            with urllib.request.urlopen(f"{address}?{urllib.parse.urlencode(parameters)}", timeout=60) as answer:
                held = json.loads(answer.read())
            break
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return
            if e.code not in (429, 500, 502, 503, 504) or attempt == TRIES - 1:
                raise
        except urllib.error.URLError:
            if attempt == TRIES - 1:
                raise
        time.sleep(WAIT * 2**attempt)
    yield from map(json.dumps, items(request, held))


def items(request: Request, answer: dict) -> list[dict]:
    """The works inside an answer."""
    if request.kind == "work":
        return [answer]
    if request.kind == "references":
        return [r for r in answer.get("references") or [] if r]
    for name in ITEMS[request.source]:
        answer = (answer or {}).get(name) or {}
    found = list(answer or [])
    return [r["citingPaper"] for r in found if r.get("citingPaper")] if request.source == "semanticscholar" and request.kind == "cited_by" else found


def _year(source: str, payload: str) -> int | None:
    item = json.loads(payload)
    if source == "inspire":
        info = (item.get("metadata") or {}).get("publication_info") or [{}]
        return info[0].get("year")
    return item.get("publication_year" if source == "openalex" else "year")


class _Partition(InputPartition):
    def __init__(self, number: int, request: Request):
        self.number, self.request = number, request


class IndexReader(DataSourceReader):
    def __init__(self, options: dict):
        self.requests = [Request(**r) for r in json.loads(options["requests"])]
        self.root = options.get("answers", "")
        self.low, self.high = (int(options[o]) if options.get(o) else None for o in ("low", "high"))

    def partitions(self) -> list[InputPartition]:
        return [_Partition(k, r) for k, r in enumerate(self.requests)]

    def read(self, partition: _Partition) -> Iterator[tuple]:
        r = partition.request
        about = (partition.number, r.source, r.kind, r.asked)
        try:
            answer = recorded(self.root, r, self.low, self.high) if self.root else over_http(r, self.low, self.high)
            found = [(*about, place, _year(r.source, payload), payload, None) for place, payload in enumerate(answer)]
        except Exception as e:  # noqa: BLE001 - a dead source degrades a run and never ends it
            yield (*about, None, None, None, f"{type(e).__name__}: {e}")
            return
        yield from found[: min(r.limit, MOST[r.source])]


class IndexSource(DataSource):
    """spark.read.format("scholarly_index"): options requests (JSON list), answers (folder of a recorded log), low, high."""

    @classmethod
    def name(cls) -> str:
        return "scholarly_index"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> IndexReader:
        return IndexReader(self.options)


def answers(spark: SparkSession, requests: list[Request], root: str = "", low: int | None = None, high: int | None = None) -> DataFrame:
    """SCHEMA rows of the requests' answers, request by request."""
    spark.dataSource.register(IndexSource)
    reader = spark.read.format("scholarly_index").option("requests", json.dumps([asdict(r) for r in requests])).option("answers", root)
    for name, value in (("low", low), ("high", high)):
        if value is not None:
            reader = reader.option(name, str(value))
    return reader.load()


def record(found: DataFrame, root: str) -> None:
    """Appends answers (key, place, payload) to a recorded log. A request without items has one row with a null payload."""
    line = F.to_json(F.struct("place", "payload"), {"ignoreNullFields": "false"})
    request = F.substring(F.sha2("key", 256), 1, 24)
    found.select(request.alias("request"), line.alias("value")).repartition("request").write.partitionBy("request").mode("append").text(root)


def works_of(found: DataFrame, first: int = 0) -> DataFrame:
    """Works of all sources with position, request and kind: in order of requests, then of places in their answers.

    Positions begin at `first`; those of one request lie under a billion.
    """
    place = (F.lit(first).cast("long") + F.col("request").cast("long") * 1_000_000_000 + F.col("place")).alias("position")
    held = found.where("payload is not null").select("source", "payload", "request", "kind", place)
    out = None
    for source, read in (("openalex", payloads.from_openalex), ("semanticscholar", payloads.from_semantic_scholar), ("inspire", payloads.from_inspire)):
        part = read(held.where(F.col("source") == source), keep=("position", "request", "kind"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("work_id", F.col("position")).withColumn("is_seed", F.col("kind") == "doi")


def retrieved(found: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """The works of a search, seeds first if their requests come first, inside the window."""
    works = works_of(found)
    return works.where(F.col("is_seed") | in_years(F.col("year"), low, high))


def report(found: DataFrame, sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """(source, requests, hits, failed, error, silent): what each source brought; silent sources brought nothing at all."""
    counts = found.groupBy("source").agg(F.countDistinct("request").alias("requests"), F.count("payload").alias("hits"), F.count("error").alias("failed"), F.min("error").alias("error"))
    every = found.sparkSession.createDataFrame([(s,) for s in sources], "source string")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(counts, "source", "left").select("source", zero("requests"), zero("hits"), zero("failed"), "error", (F.coalesce("hits", F.lit(0)) == 0).alias("silent"))


def harvest(seeds: list[dict], per_query: int, refs_per_seed: int, sources: tuple[str, ...]) -> list[Request]:
    """The requests that expand seeds (source_ids, references): citers, the first references, and a second graph's references if it is in use."""
    out = []
    for seed in seeds:
        ids = seed["source_ids"] or {}
        if ids.get("openalex"):
            out.append(Request("openalex", "cited_by", ids["openalex"], per_query))
            out += [Request("openalex", "work", r, 1) for r in (seed["references"] or [])[:refs_per_seed]]
        if ids.get("semanticscholar") and "semanticscholar" in sources:
            out.append(Request("semanticscholar", "references", ids["semanticscholar"], MOST["semanticscholar"]))
    return out
