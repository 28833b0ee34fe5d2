"""Fuzzy line dedup in DataFrame operations only.

Lines are normalised (lower case, one space for white space) and equal ones collapse into one class. A class is
sketched by minwise hashes of its character shingles: SHINGLE bytes of UTF-8 that begin at word starts, at characters of
three bytes or more (scripts without spaces), and at every byte of a long token after its first SHINGLE. They are put
together from the words, or tried at every byte in scripts without spaces, then exploded and aggregated, so that the
minima are taken map-side in generated code. Pairs of minima form the bands.
Classes that share a band are compared: first with their bucket's lead, then with PIVOTS of its classes, then all pairs
of the bucket that these have not brought into one component. Large buckets are dealt into blocks that meet block
against block. Bitmaps of the shingle sets, made once a class, leave out pairs that cannot be similar; no other pair is
left out. The rest are verified by their exact Jaccard similarity over all VERIFY-character shingles of both lines (as
64-bit hashes), and verified pairs are joined into components by distributed union-find. One line of a component stays:
the earliest by (doc_id, line).

Null text counts as empty. Blank lines and lines under `least_chars` characters (without spaces around them) always stay
and are in no component but their own; least_chars=1 compares every line. A line of fewer than VERIFY characters has
itself as its only shingle. Repeated rows are repeated lines: where a row is there twice, its earliest line is kept in
both. Very long lines are sketched and verified whole. An empty table gives no lines. Other columns, whatever their
names, are carried along by `cleaned`, which keeps every row: a document that loses all its lines has an empty text.
Classes are told apart by 128 bits of hash, linked by 64 of them.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibloom.llm.common import components, written

SHINGLE, VERIFY, SIMILARITY, LEAST_CHARS = 12, 5, 0.8, 10
BANDS = 6
#: Classes of a bucket that all of it meets first; classes of a cell that meet in one task.
PIVOTS, BLOCK = 8, 256
#: Words of 64 bits of the bitmaps that leave out pairs before they are verified, and how many of them are tried first.
WORDS, FIRST = 32, 8
#: Masks whose exclusive-or with a hash orders the shingles anew: multiples of an odd constant.
MASKS = [((k + 1) * 0x9E3779B97F4A7C15) % (1 << 64) - (1 << 63) for k in range(BANDS)]
#: A token that shingles begin inside of, found token by token: each letter is read once.
LONG = f"^(?:[^ ]{{0,{SHINGLE}}}+ )*+[^ ]{{{SHINGLE + 1}}}"
#: Base of a line's rank among all lines: doc_id * LINES + line, as a decimal.
LINES = 10**10


def normal(line: Column) -> Column:
    """Lower case, trimmed, one space for white space; the pattern is run only where it can match."""
    odd = F.lit(False)
    for gap in ("  ", "\t", "\r", "\x0b", "\f"):
        odd = odd | line.contains(gap)
    return F.lower(F.trim(F.when(odd, F.regexp_replace(line, r"[^\S ]\s*| \s+", " ")).otherwise(line)))


def lines_of(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, line, d1, d2, norm, kind): the lines that can be duplicates; line counts from 0."""
    split = docs.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("line", "raw"))  # outer: else it is split twice
    lines = split.where(F.length(F.trim("raw")) >= least_chars).select("doc_id", "line", normal(F.col("raw")).alias("norm"))
    return lines.select("doc_id", "line", *_digest(), "norm", kind().alias("kind"))


def _digest(norm: str = "norm") -> list[Column]:
    return [F.xxhash64(norm).alias("d1"), F.xxhash64(F.lit(1), norm).alias("d2")]


def _hashed(raw: Column, at: Column) -> Column:
    return F.xxhash64(F.substring(raw, at, F.lit(SHINGLE)))


def shingled(lines: DataFrame, *keep: str) -> DataFrame:
    """(keep, at, h) of lines (norm, ...): hashes of the shingles that sketches are made of; at counts from 1."""
    raw = F.col("norm").cast("binary")
    flat = lines.select(*keep, raw.alias("b"), F.octet_length("norm").alias("n"), (F.octet_length("norm") != F.length("norm")).alias("wide"), F.col("norm").rlike(LONG).alias("long"))
    # outer: else the optimizer adds a filter that makes each sequence again
    places = flat.select(*keep, "b", "wide", "long", F.explode_outer(F.sequence(F.lit(1), F.greatest(F.lit(1), "n"))).alias("at"))
    begins = (F.col("at") == 1) | (F.substring("b", F.col("at") - 1, F.lit(1)) == F.lit(b" "))
    unspaced = F.col("wide") & (F.substring("b", F.col("at"), F.lit(1)) >= F.lit(b"\xe0"))
    inside = F.col("long") & (F.col("at") > SHINGLE) & (F.instr(F.substring("b", F.col("at") - SHINGLE, F.lit(SHINGLE)).cast("string"), " ") == 0)
    return places.where(begins | unspaced | inside).select(*keep, "at", _hashed(F.col("b"), F.col("at")).alias("h"))


def kind() -> Column:
    """How a line's shingles are cut: 0 from words, 1 from words and inside long ones, 2 byte by byte (characters of three bytes)."""
    narrow = (F.octet_length("norm") == F.length("norm")) | ~F.col("norm").rlike(r"[^\x00-\u07FF]")
    return F.when(~narrow, 2).when(F.col("norm").rlike(LONG), 1).otherwise(0)


def _text_from(words: DataFrame) -> Column:
    """The word of words (w, at, word) with as many words after it as a shingle needs."""
    after = [F.get("w", F.col("at") + k) for k in range(1, SHINGLE // 2 + 1)]
    enough = (F.octet_length("word") < SHINGLE) & (F.octet_length("word") + F.octet_length(after[0]) + F.octet_length(after[1]) >= SHINGLE - 2)
    return F.when(enough, F.concat_ws(" ", "word", *after[:2])).otherwise(F.concat_ws(" ", "word", *after)).cast("binary")


def _worded(lines: DataFrame, *keep: str) -> DataFrame:
    words = lines.select(*keep, F.split("norm", " ").alias("w"))
    return words.select(*keep, "w", F.posexplode_outer("w").alias("at", "word"))


def worded(lines: DataFrame, *keep: str) -> DataFrame:
    """What `shingled` gives for lines of kind 0; at counts words."""
    words = _worded(lines, *keep)
    return words.select(*keep, (F.col("at") + 1).alias("at"), _hashed(_text_from(words), F.lit(1)).alias("h"))


def long_worded(lines: DataFrame, *keep: str) -> DataFrame:
    """What `shingled` gives for lines of kind 1: also from each byte of a token after its first SHINGLE, up to the space."""
    words = _worded(lines, *keep)
    # the end of the last word is the end of the line
    last = F.octet_length("word") - F.when(F.col("at") == F.size("w") - 1, 1).otherwise(0)
    inside = F.when(last >= SHINGLE, F.concat(F.array(F.lit(0)), F.sequence(F.lit(SHINGLE), last))).otherwise(F.array(F.lit(0)))
    begins = words.select(*keep, "at", _text_from(words).alias("text"), inside.alias("begins")).select(*keep, "at", "text", F.explode_outer("begins").alias("begin"))
    return begins.select(*keep, (F.col("at") + F.col("begin") + 1).alias("at"), _hashed(F.col("text"), F.col("begin") + 1).alias("h"))


def sketched(lines: DataFrame) -> DataFrame:
    """(d1, d2, doc_id, line, b0, ...) of each class of lines: its earliest line, and its band keys, of two minima each."""
    rank = (F.col("doc_id").cast("decimal(20,0)") * F.lit(LINES).cast("decimal(11,0)") + F.col("line")).cast("decimal(38,0)")
    ranked = lines.select("d1", "d2", rank.alias("rank"), "norm", "kind")
    ends = [f(F.col("h").bitwiseXOR(F.lit(MASKS[b]))).alias(f"{f.__name__}{b}") for b in range(BANDS) for f in (F.min, F.max)]
    # each kind is aggregated before they are united, so that no row is made of a shingle
    each = [cut(ranked.where(F.col("kind") == k), "d1", "d2", "rank").groupBy("d1", "d2").agg(F.min(F.when(F.col("at") == 1, F.col("rank"))).alias("rank"), *ends) for k, cut in enumerate((worded, long_worded, shingled))]
    found = reduce(DataFrame.unionByName, each)
    doc = F.floor(F.col("rank") / LINES)
    place = [doc.cast("long").alias("doc_id"), (F.col("rank") - doc * LINES).cast("int").alias("line")]
    return found.select("d1", "d2", *place, *[F.xxhash64(F.lit(b), f"min{b}", f"max{b}").alias(f"b{b}") for b in range(BANDS)])


def shingles(raw: str) -> Column:
    """Hashes of the distinct VERIFY-character shingles of a text in UTF-32.

    The text is the variable r of an outer lambda: a column in the inner one would be copied for each of its places.
    """
    begins = lambda r: F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(r) - (4 * VERIFY - 1)), F.lit(4))
    each = lambda r: F.transform(begins(r), lambda i: F.xxhash64(F.substring(r, i, F.lit(4 * VERIFY))))
    return F.array_distinct(F.transform(F.array(raw), each)[0])


def scored(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, x, y) with their exact Jaccard similarity over the sets of VERIFY-character shingles.

    Each step is a projection of its own, so that nothing is computed twice.
    """
    raw = pairs.select("a", "b", *[F.encode(c, "UTF-32").alias(c) for c in ("x", "y")])
    sets = raw.select("a", "b", shingles("x").alias("p"), shingles("y").alias("q"))
    sizes = sets.select("a", "b", F.size(F.array_intersect("p", "q")).alias("both"), (F.size("p") + F.size("q")).alias("n"))
    return sizes.select("a", "b", (F.col("both") / (F.col("n") - F.col("both"))).alias("jaccard"))


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar. texts: (rep, norm) of all their classes."""
    side = lambda rep, norm: texts.select(F.col("rep").alias(rep), F.col("norm").alias(norm))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    # written before it is filtered: a filter pushed below the sets would compute them again
    return written(scored(both), "scored").where(F.col("jaccard") >= SIMILARITY).select("a", "b")


def _texts(lines: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, norm) of the classes reps (rep, doc_id, line).

    A row that is there twice gives a class twice, which adds pairs but no link.
    """
    return written(lines.select("doc_id", "line", "norm").join(reps.hint("shuffle_hash"), ["doc_id", "line"]).select("rep", "norm"), "texts")


def _bitmaps(texts: DataFrame) -> DataFrame:
    """(rep, n, w0, w1, ...): how many shingles each class has, and a bitmap of WORDS words of them.

    Dealt by class once: bits become words, then words a row, without another exchange.
    """
    sets = texts.repartition("rep").select("rep", F.encode("norm", "UTF-32").alias("raw")).select("rep", shingles("raw").alias("s"))
    bit = sets.select("rep", F.size("s").alias("n"), F.explode_outer("s").alias("h"))
    word = bit.select("rep", "n", F.expr(f"shiftright(cast(h & {64 * WORDS - 1} as int), 6)").alias("k"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("w"))
    word = word.groupBy("rep", "k").agg(F.max("n").alias("n"), F.bit_or("w").alias("w"))
    words = [F.bit_or(F.when(F.col("k") == k, F.col("w")).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(WORDS)]
    return written(word.groupBy("rep").agg(F.max("n").alias("n"), *words), "bitmaps")


def _side(bitmaps: DataFrame, rep: str, n: str, w: str, words: int = WORDS) -> DataFrame:
    return bitmaps.select(F.col("rep").alias(rep), F.col("n").alias(n), *[F.col(f"w{k}").alias(f"{w}{k}") for k in range(words)])


def _possible(pairs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The pairs (a, b) that can be similar by their classes' bitmaps."""
    return pairs.join(_side(bitmaps, "a", "n", "x"), "a").join(_side(bitmaps, "b", "m", "y"), "b").where(_may_link()).select("a", "b")


def _may_link(words: int = WORDS) -> Column:
    """Whether sets of n and m shingles with bitmaps x0, x1, ... and y0, y1, ... can be similar.

    Each bit that only one of the bitmaps has is a shingle that only one of the sets has, so these bits, of some words as of
    all, are a lower bound of the sets' difference; hashes that meet in a bit do not loosen it.
    """
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"x{k}").bitwiseXOR(F.col(f"y{k}"))) for k in range(words)])
    near = F.least("n", "m") >= SIMILARITY * F.greatest("n", "m")
    return near & ((1 + SIMILARITY) * differ <= (1 - SIMILARITY) * (F.col("n") + F.col("m")) + 1e-6)


def _several(held: DataFrame, least: int = 2) -> DataFrame:
    """The rows of held (band, bucket, rep, comp) in buckets of `least` classes at least that are in two components or more, with the bucket's size."""
    parts = held.groupBy("bucket").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    return held.join(parts.where((F.col("lo") != F.col("hi")) & (F.col("size") >= least)).select("bucket", "size"), "bucket")


def _pivoted(held: DataFrame) -> DataFrame:
    """Pairs (a, b) of each class of a bucket and its pivots, one for each of PIVOTS shares of the bucket.

    In a bucket of PIVOTS classes at most, all are pivots and it is met whole; in a larger one, what is similar to many
    is found without all pairs.
    """
    share = F.when(F.col("size") <= PIVOTS, F.col("rep")).otherwise(F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(PIVOTS)))
    pivots = held.groupBy("bucket", share.alias("share")).agg(F.min(F.struct("rep", "comp")).alias("p")).select("bucket", F.col("p.rep").alias("pivot"), F.col("p.comp").alias("q"))
    met = held.join(pivots, "bucket").where("comp <> q")
    return met.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()


def _met(held: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """All pairs (a, b) of a bucket in held (band, bucket, rep, comp) that are in two components and can be similar.

    What is outside a bucket's largest component meets all of the bucket, block by block, first by FIRST words of the
    bitmaps; a pair is taken in the first band of held that holds it.
    """
    parts = held.groupBy("bucket", "comp").agg(F.count("*").alias("size"))
    sizes = parts.groupBy("bucket").agg(F.sum("size").alias("size"), F.max(F.struct("size", "comp")).alias("most"))
    sizes = sizes.select("bucket", F.col("most.comp").alias("most"), F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("size") - F.col("most.size")) / BLOCK).cast("int").alias("rest"))
    keys = range(BANDS)
    bands = held.groupBy("rep").agg(*[F.max(F.when(F.col("band") == b, F.col("bucket"))).alias(f"b{b}") for b in keys])
    full = held.drop("size").join(sizes, "bucket").join(bands, "rep")
    block = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = full.where("comp <> most").select("bucket", "most", "band", *[F.col(f"b{b}").alias(f"c{b}") for b in keys], block("rest").alias("i"), every("blocks").alias("k"), F.col("rep").alias("a"), F.col("comp").alias("p"))
    y = full.select("bucket", *[f"b{b}" for b in keys], every("rest").alias("i"), block("blocks").alias("k"), F.col("rep").alias("b"), F.col("comp").alias("q"))
    first = reduce(Column.__and__, [(F.col("band") <= b) | ~F.col(f"b{b}").eqNullSafe(F.col(f"c{b}")) | F.col(f"b{b}").isNull() for b in keys])
    some = [_side(bitmaps, *names, FIRST) for names in (("a", "n", "x"), ("b", "m", "y"))]
    once = (F.col("p") != F.col("q")) & ((F.col("q") == F.col("most")) | (F.col("a") < F.col("b")))
    met = x.join(some[0], "a").join(y.join(some[1], "b"), ["bucket", "i", "k"]).where(once & first & _may_link(FIRST))
    return _possible(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), bitmaps)


def _held(classes: DataFrame) -> DataFrame:
    """(bucket, rep, lead) of the classes in buckets of two classes at least, lead being the bucket's least class, written.

    The last three bits of a bucket are its band, so that both sides of the join read one exchange of the same columns.
    """
    banded = classes.select(F.col("d1").alias("rep"), F.explode(F.array(*[F.col(f"b{b}").bitwiseAND(F.lit(-8)).bitwiseOR(F.lit(b)) for b in range(BANDS)])).alias("bucket")).repartition("bucket")
    met = banded.groupBy("bucket").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead <> last").select("bucket", "lead")
    return written(banded.join(met.hint("shuffle_hash"), "bucket"), "buckets")


def _discard(table: DataFrame) -> None:
    """Deletes a written table that nothing reads any more: all lines beside what is shuffled later would take disk."""
    spark, files = table.sparkSession, table.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def line_classes(docs: DataFrame, least_chars: int = LEAST_CHARS) -> tuple[DataFrame, DataFrame]:
    """(rows, members): every line's digest, and each class with the earliest line of its component."""
    lines = lines_of(docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()), least_chars)
    whole = written(lines, "lines")
    classes = written(sketched(whole), "classes")
    rows = written(whole.select("doc_id", "line", "d1", "d2"), "rows")
    _discard(whole)
    held = _held(classes)
    firsts = classes.select(F.col("d1").alias("rep"), "d2", "doc_id", "line")
    texts = _texts(lines, firsts.join(held.select("rep").distinct().hint("shuffle_hash"), "rep").drop("d2"))
    bitmaps = _bitmaps(texts)
    pairs = held.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    links = _linked(written(_possible(pairs, bitmaps), "pairs"), texts)
    comps = components(links).withColumnRenamed("id", "rep")
    for least in (2, PIVOTS + 1):  # what the lead, then the pivots leave apart; what they met is verified
        known = held.join(comps.hint("shuffle_hash"), "rep", "left").select(F.col("bucket").bitwiseAND(F.lit(7)).cast("int").alias("band"), "bucket", "rep", F.coalesce("component", "rep").alias("comp"))
        inner = written(_several(known, least), "inner")
        if inner.isEmpty():
            break
        pairs = _possible(_pivoted(inner), bitmaps) if least == 2 else _met(inner, bitmaps)
        links = links.unionByName(_linked(written(pairs, "pairs"), texts))
        comps = components(links).withColumnRenamed("id", "rep")
    linked = firsts.join(comps.hint("shuffle_hash"), "rep").select("rep", "component", F.struct("doc_id", "line").alias("first"))
    kept = linked.groupBy("component").agg(F.min("first").alias("kept"))
    kept = linked.join(kept, "component").select("rep", "kept")
    members = firsts.join(kept.hint("shuffle_hash"), "rep", "left").select(F.col("rep").alias("d1"), "d2", F.coalesce("kept", F.struct("doc_id", "line")).alias("component"))
    return rows, members


def fuzzy_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, line, kept_doc_id, kept_line, kept) for every line of `least_chars` characters at least."""
    rows, members = line_classes(docs, least_chars)
    out = rows.join(members, ["d1", "d2"]).select("doc_id", "line", F.col("component.doc_id").alias("kept_doc_id"), F.col("component.line").alias("kept_line"))
    return out.withColumn("kept", (F.col("doc_id") == F.col("kept_doc_id")) & (F.col("line") == F.col("kept_line")))


def cleaned(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """All rows and columns of docs, text without the lines that do not stay."""
    id_, own = f"id_{uuid.uuid4().hex}", f"gone_{uuid.uuid4().hex}"
    gone = fuzzy_lines(docs, least_chars).where(~F.col("kept")).groupBy(F.col("doc_id").alias(id_)).agg(F.collect_set("line").alias(own))
    gone = written(gone, "gone")
    split = F.split("text", "\n")
    rest = F.array_join(F.filter(split, lambda x, i: ~F.array_contains(own, i)), "\n")
    out = docs.join(gone.hint("merge"), docs["doc_id"] == gone[id_], "left")
    return out.withColumn("text", F.when(F.col(own).isNull(), F.col("text")).otherwise(rest)).select(*docs.columns)
