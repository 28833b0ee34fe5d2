"""Main text of web pages by markup and a suffix array over each host.

A page is read into blocks of words with the place they stand in (article, furniture or neither). Blocks inside menus,
headers, footers, side bars, notices, adverts, forms and reader comments never count as text. Where a page marks up an
article, what stands in it is kept, and of that a block goes only if WIDE of the host's marked pages hold the same
block, so that copied articles and their passages stay. Pages without such markup are decided by the suffix array:
the word streams of a host's unmarked pages are laid end to end, a suffix array over the first REACH words of every
suffix finds the runs of words that REPEATS distinct pages hold, blocks that such runs cover are boilerplate, and what
is left is the text. Pages whose kept blocks are all equal are copies and count as one page in both, so that copies never
make each other boilerplate.

Unmarked pages of one host are dealt into chunks of about CHUNK_BYTES of blocks, copies into the same chunk, so a host of
any size is worked on in bounded pieces. A run of LEAST words or more goes over k pages only if each LEAST words of it
do; so the chunks of a large host count, for every LEAST words in a row, the distinct pages that hold them, the counts
are summed over the host, and each chunk decides by the host's sums what the suffix array decides on a small host: the
number of chunks does not change a result.

Null html is empty and has an empty text, null url is a host of its own, an empty table gives no rows. Broken markup is
read to its end, an article start closes what was left open. Very long pages are read whole. Copies of a page and
repeated rows get equal text. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import html as markup
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibloom.llm.common import MULTIPLIER, U64, bounded_batches, groups, mix, partitions, sliced, written

#: Places of a suffix that are sorted (a power of two; block beginnings take one each), least words of a repeated run.
REACH, LEAST = 16, 3
#: Distinct pages that make a run of unmarked pages boilerplate; least pages that make a block of an article so, and their share.
REPEATS, WIDE_PAGES, WIDE = 3, 8, 0.5
CHUNK_BYTES = 2 << 20
#: Hosts of several chunks whose sizes are broadcast, at most.
BROADCAST_HOSTS = 50_000

# Element names of HTML.
RAW = "script|style|noscript|template|svg|iframe|object|textarea|title|canvas|audio|video"
FURNITURE = frozenset("nav footer aside form button select dialog menu head fieldset label input option".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end without an end tag when one of their kind, or what holds them, begins or ends.
OPTIONAL = frozenset("p li dd dt td th tr option".split())
MARKED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|bottombar|breadcrumbs?|comments?|commentlist|consent|cookies?|copyright|disclaimer|disqus|footer|gdpr|hidden|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|paywall|popup|promo\w*|related|reply|respond|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|subscription|toolbar|topbar|widget)(?:$|[\s_-]|s(?:$|\s))", re.I)
#: Words that may stand beside one of MARKED's in the class of a part of an article that is none of its text.
BESIDE = frozenset("area bar block body bottom box btn button buttons center code container content cta element form group head header icon icons inline inner item items left link links list outer pages panel post posts right row section slot small stories tags text title top unit widget wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({RAW})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>", re.S | re.I)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_VALUE = re.compile(r"\"[^\"]*\"|'[^']*'|=\s*[^\s\"'>]+")

OUTSIDE, INSIDE, SKIPPED = 0, 1, 2


def _furniture(value: str, now: int) -> bool:
    """Whether a class or id names furniture. Inside an article one of its names has to say nothing else: `share-buttons` is, `related-work` is not."""
    if now != INSIDE:
        return MARKED.search(value) is not None
    for one in value.lower().split():
        parts = [p for p in re.split(r"[_-]+", one) if p]
        told = [MARKED.search(p) is not None for p in parts]
        if any(told) and all(t or p in BESIDE or p.isdigit() for t, p in zip(told, parts)):
            return True
    return False


def _place(name: str, attributes: str, now: int) -> int:
    """Where the contents of an element stand, given where it stands itself."""
    if name in ("article", "main"):
        marked = attributes and any(MARKED.search(a[1] or a[2] or a[3]) for a in _ATTRIBUTE.findall(attributes) if a[0].lower() in ("class", "id"))
        return SKIPPED if marked else INSIDE
    if now == SKIPPED:
        return SKIPPED
    if name in FURNITURE or name == "header" and now != INSIDE:
        return SKIPPED
    if attributes:
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values)
            if key in ("class", "id") and _furniture(value, now) or key == "role" and value.lower() in ROLES or key == "aria-hidden" and value.lower() == "true":
                return SKIPPED
            if key == "itemprop" and value == "articleBody" or key == "role" and value.lower() in ("main", "article"):
                return INSIDE
        if "hidden" in attributes and re.search(r"\shidden(?=[\s=/]|$)", _VALUE.sub('""', attributes)):
            return SKIPPED
    return now


def blocks(page: str) -> list[tuple[int, str]]:
    """(place, text) of the blocks of a page, in order, white space as one space, character references decoded."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    held: list[str] = []
    now, at = OUTSIDE, 0

    def flush() -> None:
        if held:
            text = " ".join(markup.unescape("".join(held)).split())
            if text:
                out.append((now, text))
            held.clear()

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if m[2]:
            if name in BLOCKS:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if stack[k][0] in ("article", "main", "body") and name in OPTIONAL:
                    break
            now = stack[-1][1] if stack else OUTSIDE
        elif name in VOID:
            if name == "br":
                held.append(" ")
            elif name in BLOCKS:
                flush()
        else:
            if name in BLOCKS:
                flush()
                if name in ("article", "main"):
                    while stack and stack[-1][0] not in ("body", "html", "div", "section", "main", "article"):
                        stack.pop()
                elif stack and stack[-1][0] in OPTIONAL and (stack[-1][0] == name or stack[-1][0] == "p"):
                    stack.pop()
                now = stack[-1][1] if stack else OUTSIDE
            place = _place(name, m[4], now)
            if not m[4].rstrip().endswith("/") or name in BLOCKS:
                stack.append((name, place))
                now = place if name in BLOCKS or place == SKIPPED else now
    if at < len(page):
        held.append(page[at:])
    flush()
    return out


def bodies_of(pages: list[list[str]]) -> list[int]:
    """For each page of kept texts the number of its body, equal for copies."""
    known: dict[tuple[str, ...], int] = {}
    return [known.setdefault(tuple(p), len(known)) for p in pages]


def _kept_place(read: list[tuple[int, str]]) -> int:
    return INSIDE if any(place == INSIDE for place, _ in read) else OUTSIDE


def kept(read: list[tuple[int, str]]) -> list[str]:
    """The texts that markup lets stay, of the blocks of a page."""
    return [t for place, t in read if place == _kept_place(read)]


def wide_limit(n_bodies: int) -> int:
    return max(WIDE_PAGES, int(np.ceil(WIDE * n_bodies)))


def repeated(pages: list[list[str]], bodies: list[int], least: int = LEAST) -> list[np.ndarray]:
    """For each block of each page, over how many distinct pages at least its repeated runs go.

    pages: the blocks' texts of each page; pages of one body count once. A block's count is REPEATS if every word of the
    block lies in a run of `least` words or more that as many distinct pages hold, else 1.
    """
    words: dict[str, int] = {}
    stream, page_of, block_of, n_blocks = [], [], [], 0
    for p, texts in enumerate(pages):
        for text in texts:
            ids = [words.setdefault(w, len(words) + 2) for w in text.split()]
            stream += [1, *ids]  # 1: a block begins
            block_of += [n_blocks] * (len(ids) + 1)
            page_of += [bodies[p]] * (len(ids) + 1)
            n_blocks += 1
        stream += [1, -1 - p]  # ends that no other page has
        block_of += [n_blocks, n_blocks]
        page_of += [bodies[p]] * 2
    count = np.ones(n_blocks + 1, np.int64)
    if len(pages) >= 2 and stream:
        s, page = np.array(stream, np.int64), np.array(page_of)
        n = len(s)
        rank = s - s.min()
        ranks, reach = [rank], 1
        while reach < REACH:  # prefix doubling: ranks of the first 1, 2, 4 ... words of every suffix
            after = np.full(n, -1, np.int64)
            after[: max(0, n - reach)] = rank[reach:]
            rank = np.unique(rank * (int(rank.max()) + 2) + after + 1, return_inverse=True)[1].astype(np.int64)
            ranks.append(rank)
            reach *= 2
        order = np.argsort(rank, kind="stable")
        common = np.zeros(n, np.int64)  # words that a suffix shares with the one before it, up to REACH
        left, right = order[:-1].copy(), order[1:].copy()
        for r, size in zip(reversed(ranks), [1 << k for k in range(len(ranks) - 1, -1, -1)]):
            fits = (left < n) & (right < n)
            same = np.zeros(len(left), bool)
            same[fits] = r[left[fits]] == r[right[fits]]
            common[1:][same] += size
            left[same] += size
            right[same] += size
        common = np.minimum(common, REACH)
        block = np.array(block_of)
        reach_of = _shared(order, common, page, REPEATS, least)
        covered = np.zeros(n + 1, np.int64)
        # a run needs words of its own: beginnings of blocks are no words, so a heading of one word is no run
        words_to = np.concatenate((np.zeros(1, np.int64), np.cumsum(s > 1)))
        hit = words_to[np.arange(n) + reach_of] - words_to[:-1] >= least
        np.add.at(covered, np.flatnonzero(hit), 1)
        np.add.at(covered, np.flatnonzero(hit) + reach_of[hit], -1)
        bare = np.bincount(block, weights=(np.cumsum(covered)[:n] == 0) & (s > 1), minlength=n_blocks + 1)
        count[bare[: n_blocks + 1] == 0] = REPEATS
    out, at = [], 0
    for texts in pages:
        out.append(count[at : at + len(texts)])
        at += len(texts)
    return out


def _shared(order: np.ndarray, common: np.ndarray, page: np.ndarray, k: int, least: int) -> np.ndarray:
    """For every suffix the longest length, `least` at the shortest, of a prefix that k distinct pages hold; else 0."""
    n, out = len(order), np.zeros(len(order), np.int64)
    if k > n:
        return out
    length = least
    while length <= REACH:
        start = np.concatenate(([True], common[1:] < length))
        group = np.cumsum(start) - 1
        size = np.bincount(group)
        many = np.flatnonzero(size[group] >= k)
        if not len(many):
            break
        wide = int(page.max()) + 1
        pair = np.unique(group[many] * wide + page[order[many]])
        pages = np.bincount(pair // wide, minlength=len(size))
        hit = order[many[pages[group[many]] >= k]]
        if not len(hit):
            break
        out[hit] = length
        length = length + 1 if length < 8 else length * 2
    return np.minimum(out, n - np.arange(n))


def grams(pages: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram, at, page, block): the digest of every LEAST words in a row of a page, and where blocks begin between them.

    gram and at: digests and the number of the word that each begins with; page and block: of each word.
    """
    words: dict[str, int] = {}
    stream, page_of, block_of, n_blocks = [], [], [], 0
    for p, texts in enumerate(pages):
        for text in texts:
            ids = [words.setdefault(w, len(words)) for w in text.split()]
            stream += ids
            block_of += [n_blocks] * len(ids)
            page_of += [p] * len(ids)
            n_blocks += 1
    raw = b"".join(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in words)
    digest = np.frombuffer(raw, "<u8").astype(np.uint64)[np.array(stream, np.int64)] if stream else np.zeros(0, np.uint64)
    page, block, n = np.array(page_of, np.int64), np.array(block_of, np.int64), max(0, len(stream) - LEAST + 1)
    gram = np.zeros(n, np.uint64)
    for k in range(LEAST):
        begins = (block[k : n + k] != block[k - 1 : n + k - 1]).astype(np.uint64) if k else np.zeros(n, np.uint64)
        gram = mix(gram * U64(MULTIPLIER) + digest[k : n + k] + begins * U64(0x9E6C63D0676A9A99))
    at = np.flatnonzero(page[:n] == page[LEAST - 1 :])
    return gram[at].view(np.int64), at, page, block


def gram_counts(pages: list[list[str]], bodies: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(gram, count): over how many distinct bodies each gram of one chunk goes."""
    gram, at, page, _ = grams(pages)
    known, place = np.unique(gram, return_inverse=True)
    body = np.array(bodies, np.int64)[page[at]]
    wide = max(bodies, default=0) + 1
    return known, np.bincount(np.unique(place * wide + body) // wide, minlength=len(known))


def repeated_on_host(pages: list[list[str]], hot: np.ndarray) -> list[np.ndarray]:
    """What `repeated` gives, by the sums of a host: REPEATS pages of it hold the grams hot (sorted)."""
    gram, at, page, block = grams(pages)
    n_blocks = sum(len(texts) for texts in pages)
    out = np.ones(n_blocks, np.int64)
    covered = np.zeros(len(page), bool)
    for j in range(LEAST):
        covered[at[np.isin(gram, hot)] + j] = True
    bare = np.bincount(block, weights=~covered, minlength=n_blocks)
    out[bare == 0] = REPEATS
    return np.split(out, np.cumsum([len(texts) for texts in pages])[:-1])


def _texts(pages: list[list[str]], counts: list[np.ndarray]) -> list[str]:
    return ["\n\n".join(t for t, c in zip(own, count.tolist()) if c < REPEATS) for own, count in zip(pages, counts)]


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, host, body, marked, texts) of pages: the texts that markup lets stay, a line each, and their digest."""
    for batch in sliced(batches, "html"):
        read = [blocks(p) for p in batch.column("html").to_pylist()]
        texts = ["\n".join(kept(r)) for r in read]
        body = [int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for t in texts]
        columns = [pa.array(body, pa.int64()), pa.array([_kept_place(r) == INSIDE for r in read], pa.bool_()), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("page_id", "url", "host")] + columns, names=["page_id", "url", "host", "body", "marked", "texts"])


def _pages_of(table: pa.Table) -> list[list[str]]:
    return [t.split("\n") if t else [] for t in table.column("texts").to_pylist()]


def _result(table: pa.Table, texts: list[str]) -> pa.RecordBatch:
    ids, urls = (table.column(c).combine_chunks() for c in ("page_id", "url"))
    return pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages of hosts of one chunk."""
    for table in groups(batches, "chunk"):
        pages = _pages_of(table)
        yield _result(table, _texts(pages, repeated(pages, bodies_of(pages))))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, chunk, gram, n) of each chunk."""
    for table in groups(batches, "chunk"):
        pages = _pages_of(table)
        gram, n = gram_counts(pages, bodies_of(pages))
        host, chunk, size = table.column("host")[0].as_py(), table.column("chunk")[0].as_py(), len(gram)
        yield pa.RecordBatch.from_arrays([pa.array([host] * size, pa.string()), pa.array(np.full(size, chunk)), pa.array(gram), pa.array(n.astype(np.int64))], names=["host", "chunk", "gram", "n"])


def _decide(_key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """The pages of one chunk by the grams (chunk, gram) that are repeated on its host."""
    pages = _pages_of(left)
    hot = np.sort(right.column("gram").to_numpy())
    return pa.Table.from_batches([_result(left, _texts(pages, repeated_on_host(pages, hot)))])


_KIND = "page_id long, url string, text string, n_chars long"


def unmarked(read: DataFrame) -> DataFrame:
    """Results of pages (page_id, url, host, body, texts) without an article, by the suffix arrays of their hosts."""
    n = partitions(read.sparkSession)
    sizes = read.groupBy("host").agg(F.ceil(F.sum(F.octet_length("texts").cast("long")) / CHUNK_BYTES).cast("int").alias("chunks"))
    large = written(sizes.where("chunks > 1"), "hosts")
    n_large = large.count()
    hosts = F.broadcast(large) if n_large <= BROADCAST_HOSTS else large  # a checked bound; beyond it blocks are shuffled once more

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(n, "chunk").sortWithinPartitions("chunk", "page_id")

    out = dealt(read.join(hosts, "host", "left_anti").withColumn("chunk", F.xxhash64("host"))).mapInArrow(_small, _KIND)
    if not n_large:
        return out
    chunked = read.join(hosts, "host").withColumn("chunk", F.xxhash64("host", F.pmod(F.xxhash64("body"), "chunks"))).drop("chunks")
    counts = written(dealt(chunked).mapInArrow(_count, "host string, chunk long, gram long, n long"), "grams")
    totals = counts.groupBy("host", "gram").agg(F.sum("n").alias("total")).where(F.col("total") >= REPEATS).select("host", "gram")
    mine = counts.join(totals, ["host", "gram"], "left_semi").select("chunk", "gram")
    return out.unionByName(chunked.groupBy("chunk").cogroup(mine.groupBy("chunk")).applyInArrow(_decide, _KIND))


def marked(read: DataFrame) -> DataFrame:
    """Results of pages (page_id, url, host, body, texts) with an article: without the blocks that WIDE of the host's bodies hold."""
    block = lambda t: F.xxhash64(t)
    lines = F.split("texts", "\n")
    held = read.select("host", "body", F.explode(F.transform(lines, block)).alias("block")).distinct().groupBy("host", "block").agg(F.count("*").alias("n"))
    bodies = read.select("host", "body").distinct().groupBy("host").agg(F.count("*").alias("bodies"))
    hot = held.where(F.col("n") >= WIDE_PAGES).join(bodies, "host").where(F.col("n") >= F.ceil(WIDE * F.col("bodies")))
    # of the blocks of a page, twice their mean number at most are held by half of the pages
    hot = written(hot.groupBy("host").agg(F.collect_set("block").alias("hot")), "hot")
    hosts = F.broadcast(hot) if hot.count() <= BROADCAST_HOSTS else hot
    text = F.array_join(F.when(F.col("hot").isNull(), lines).otherwise(F.filter(lines, lambda t: ~F.array_contains("hot", block(t)))), "\n\n")
    out = read.join(hosts, "host", "left").select("page_id", "url", text.alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html)."""
    bounded_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("host", F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit("")))
    read = written(rows.mapInArrow(_read_blocks, "page_id long, url string, host string, body long, marked boolean, texts string"), "blocks")
    return marked(read.where("marked").drop("marked")).unionByName(unmarked(read.where("not marked").drop("marked")))
