"""Queries over the supplied tables, one for each operator, and the SQL each is held against.

The tables hold no publications, so each query maps a table onto the works, rows or entries that its operator takes.
All run over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bibloom.functions import numeric, sql
from bibloom.functions import text as T
from bibloom.operators import bib, bib_chunks, corpus, dedup, evidence, export, gate, graph, metrics, relevance, reports, screening, search, verification
from bibloom.sources import cache, payloads, readers, retrieval
from bibloom.sources.shared import new_path, written
from bibloom.streaming import verdicts

FORBIDDEN = ["tionly", "enbleed", "ostmente"]
REQUIRED = ["the", "der", "les", "que"]
QUERY_TERMS = T.query_terms(["thtion of the ing and ander", "reation haing with ouble", "verein eaux mente"])
NOW = 2026

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def title_of(c: str | Column = "text") -> Column:
    # no further: the words of a whole text are many. Two more letters are one of a to z, or begin with one, in lower case
    begin = F.lower(F.regexp_extract(c, r"^(?:[^A-Za-z0-9\u0130\u212A]*+[A-Za-z0-9\u0130\u212A]++){0,12}+", 0))
    begin = F.regexp_extract(begin, "^(?:[^a-z0-9]*+[a-z0-9]++){0,12}+", 0)
    return F.array_join(F.regexp_extract_all(begin, F.lit("([a-z0-9]+)"), F.lit(1)), " ")


SQL_TITLE = "array_to_string(list_slice(regexp_extract_all(lower(text), '[a-z0-9]+'), 1, 12), ' ')"


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One work a document: the first twelve words as title, the text as abstract."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("work_id"), F.col("doc_id").alias("position"), title_of().alias("title"), F.col("text").alias("abstract"), F.col("source").alias("venue"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One work a part: role from its type, year from its size, citations from its price, seeds by key."""
    p = table(spark, sf_dir, "part")
    role = F.element_at(F.create_map(*[F.lit(x) for x in ("MEDIUM", "primary", "STANDARD", "review", "LARGE", "method", "PROMO", "theory", "SMALL", "primary", "ECONOMY", "")]), F.substring_index("p_type", " ", 1))
    return p.select(F.col("p_partkey").alias("work_id"), F.col("p_partkey").alias("position"), (F.lit(1980) + F.col("p_size")).cast("string").alias("year"), F.floor("p_retailprice").cast("int").alias("cited_by_count"), F.coalesce(role, F.lit("")).alias("role"), (F.col("p_partkey") % 97 == 0).alias("is_seed"), F.when(F.col("p_partkey") % 3 == 0, "include").otherwise("").alias("screen"), (F.col("p_size") % 3).cast("int").alias("found_in_round"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part cites the parts of earlier lines of its orders."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    a, b = li.alias("a"), li.alias("b")
    return a.join(b, F.expr("a.l_orderkey = b.l_orderkey and a.l_linenumber > b.l_linenumber")).select(F.col("a.l_partkey").alias("citer"), F.col("b.l_partkey").alias("cited"))


SQL_EDGES = "SELECT a.l_partkey AS citer, b.l_partkey AS cited FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber > b.l_linenumber"
SQL_COUNTS = f"SELECT cited AS work_id, count(DISTINCT citer) AS n FROM ({SQL_EDGES}) WHERE citer <> cited GROUP BY cited"
SQL_ROLE = "CASE split_part(p_type, ' ', 1) WHEN 'MEDIUM' THEN 'primary' WHEN 'STANDARD' THEN 'review' WHEN 'LARGE' THEN 'method' WHEN 'PROMO' THEN 'theory' WHEN 'SMALL' THEN 'primary' ELSE '' END"
SQL_SIGNALS = f"""SELECT p_partkey AS work_id, p_partkey AS position, 1980 + p_size AS year, {SQL_ROLE} AS role, CAST(floor(p_retailprice) AS INT) AS cited_by_count, coalesce(n, 0) AS in_corpus,
    round(CAST(floor(p_retailprice) AS DOUBLE) / greatest(1, {NOW} - (1980 + p_size) + 1), 2) AS rate FROM part LEFT JOIN ({SQL_COUNTS}) ON work_id = p_partkey"""

_SQL_TRIAGE = " ".join(f"WHEN contains(h, '{p}') THEN 'rule: mentions ''{p}'''" for p in FORBIDDEN) + " WHEN NOT (" + " OR ".join(f"contains(h, '{p}')" for p in REQUIRED) + ") THEN 'rule: none of the required subject terms present'"
_SQL_TRIAGED = f"SELECT doc_id, CASE {_SQL_TRIAGE} ELSE '' END AS reason FROM (SELECT doc_id, lower({SQL_TITLE} || ' ' || coalesce(text, '')) AS h FROM documents)"


def triaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relevance.triage(works(spark, sf_dir), REQUIRED, FORBIDDEN)


@query(f"SELECT CASE WHEN reason = '' THEN 'needs_ai' ELSE 'exclude_rule' END AS verdict, reason, count(*) AS n FROM ({_SQL_TRIAGED}) GROUP BY ALL")
def triage_counts(spark, sf_dir):
    return triaged(spark, sf_dir).groupBy(F.col("triage_verdict").alias("verdict"), F.col("triage_reason").alias("reason")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id AS work_id, len(list_intersect(list_distinct(regexp_extract_all(lower({SQL_TITLE} || ' ' || coalesce(text, '')), '[a-z0-9]+')), {QUERY_TERMS!r})) AS hits FROM documents")
def topical_score(spark, sf_dir):
    return works(spark, sf_dir).select("work_id", relevance.term_hits(relevance.haystack(), QUERY_TERMS).cast("long").alias("hits"))


@query(f"SELECT count(*) AS kept FROM documents WHERE len(list_intersect(list_distinct(regexp_extract_all(lower({SQL_TITLE} || ' ' || coalesce(text, '')), '[a-z0-9]+')), {QUERY_TERMS!r})) >= 2")
def topical_guard(spark, sf_dir):
    return relevance.on_topic(works(spark, sf_dir), QUERY_TERMS, 2).agg(F.count("*").alias("kept"))


@query("SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderkey % 7 = 0 THEN true ELSE year(o_orderdate) BETWEEN 1995 AND 1997 END")
def year_window(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("year", F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.year("o_orderdate").cast("string")))
    return o.where(relevance.in_years(F.col("year"), 1995, 1997)).select("o_orderkey")


def ranked(spark, sf_dir):
    p = parts(spark, sf_dir)
    return graph.signals(p.join(graph.counted(edges(spark, sf_dir), p), "work_id"), NOW)


@query(f"SELECT p_partkey AS work_id, coalesce(n, 0) AS in_corpus FROM part LEFT JOIN ({SQL_COUNTS}) ON work_id = p_partkey")
def in_corpus_citations(spark, sf_dir):
    return graph.counted(edges(spark, sf_dir), parts(spark, sf_dir))


@query(f"SELECT work_id, year, rate, in_corpus, cited_by_count FROM ({SQL_SIGNALS})")
def year_of_rates(spark, sf_dir):
    return ranked(spark, sf_dir).select("work_id", F.col("year_number").alias("year"), "rate", "in_corpus", "cited_by_count")


@query(f"SELECT work_id, rate, in_corpus, cited_by_count FROM ({SQL_SIGNALS}) ORDER BY rate DESC, in_corpus DESC, cited_by_count DESC, position LIMIT 50")
def rank_works(spark, sf_dir):
    return graph.top(ranked(spark, sf_dir), 50).select("work_id", "rate", "in_corpus", "cited_by_count")


_SQL_PHASED = f"""SELECT *, CASE WHEN part IN ('reviews', 'landmarks') THEN 'foundation' ELSE part END AS phase FROM (SELECT *, CASE WHEN role = 'review' THEN 'reviews' WHEN in_corpus >= 2 THEN 'landmarks' WHEN year > {NOW - 3} THEN 'frontier' ELSE 'core' END AS part FROM ({SQL_SIGNALS}))"""
_SQL_PLAN = f"""WITH p AS ({_SQL_PHASED}), f(phase, title, most, s) AS (VALUES ('foundation', 'Phase 1 -- Foundation', 8, 1), ('core', 'Phase 2 -- Core evidence', 15, 2), ('frontier', 'Phase 3 -- Frontier', 12, 3)),
    n AS (SELECT f.*, count(p.phase) AS n FROM f LEFT JOIN p USING (phase) GROUP BY ALL), k AS (SELECT CASE WHEN role IN ('review', 'primary', 'method', 'theory') THEN role ELSE 'unclassified' END AS role, count(*) AS n FROM p GROUP BY 1),
    r AS (SELECT p.*, s, most, row_number() OVER (PARTITION BY phase ORDER BY part <> 'reviews', rate DESC, in_corpus DESC, cited_by_count DESC, position) AS i FROM p JOIN f USING (phase) QUALIFY i <= most)
    SELECT 0 AS section, 0 AS spot, '| Kind | Works |' AS line UNION ALL SELECT 0, 1, '| --- | --- |'
    UNION ALL SELECT 0, v.i, '| ' || v.role || ' | ' || coalesce(k.n, 0) || ' |' FROM (VALUES ('review', 2), ('primary', 3), ('method', 4), ('theory', 5), ('unclassified', 6)) v(role, i) LEFT JOIN k USING (role)
    UNION ALL SELECT s, unnest(range(len(l))), unnest(l) FROM (SELECT s, CASE WHEN n = 0 THEN ['', '## ' || title, '', 'Nothing was placed in this phase.'] ELSE ['', '## ' || title, '', 'Showing ' || least(n, most) || ' of ' || n || '.', '', '| Cite key | Year | Role | Cites/yr | Cited here | PDF | Title |', '| --- | --- | --- | --- | --- | --- | --- |'] END AS l FROM n)
    UNION ALL SELECT s, i + 10, '| ' || CASE WHEN work_id % 2 = 0 THEN 'key' || work_id ELSE '(not in refs.bib)' END || ' | ' || year || ' | ' || CASE role WHEN '' THEN 'unclassified' ELSE role END || ' | ' || CAST(rate AS VARCHAR) || ' | ' || in_corpus || ' | ' || CASE WHEN work_id % 3 = 0 OR work_id % 5 = 0 THEN 'yes' ELSE '-' END || ' | a/b ' || work_id || ' |' FROM r
    UNION ALL SELECT s, unnest([1000, 1001]), unnest(['', (n - most) || ' further work(s) in this phase are in corpus.jsonl.']) FROM n WHERE n > most"""


@query(f"SELECT CAST(section AS INT) AS section, CAST(spot AS INT) AS spot, line FROM ({_SQL_PLAN})")
def reading_plan(spark, sf_dir):
    k = F.col("work_id")
    w = ranked(spark, sf_dir).withColumns({"title": F.concat(F.lit("a|b "), k.cast("string")), "oa_pdf_url": F.when(k % 3 == 0, "https://x").otherwise(""), "arxiv_id": F.when(k % 5 == 0, "2001.00001")})
    keys = w.where(k % 2 == 0).select("work_id", F.concat(F.lit("key"), k.cast("string")).alias("cite_key"))
    return reports.reading_plan(graph.phases(w, NOW), keys).select("place.section", F.col("place.at").alias("spot"), "line")


@query(f"""WITH s AS ({SQL_SIGNALS}) SELECT part, CASE WHEN part IN ('reviews', 'landmarks') THEN 'foundation' ELSE part END AS phase, count(*) AS n, min(position) AS first, max(rate) AS best
    FROM (SELECT *, CASE WHEN role = 'review' THEN 'reviews' WHEN in_corpus >= 2 THEN 'landmarks' WHEN year > {NOW - 3} THEN 'frontier' ELSE 'core' END AS part FROM s) GROUP BY part""")
def reading_phases(spark, sf_dir):
    return graph.phases(ranked(spark, sf_dir), NOW).groupBy("part", "phase").agg(F.count("*").alias("n"), F.min("position").alias("first"), F.max("rate").alias("best"))


@query(f"SELECT v.role, count(p.role) AS n FROM (VALUES ('review'), ('primary'), ('method'), ('theory'), ('unclassified')) v(role) LEFT JOIN (SELECT CASE WHEN {SQL_ROLE} = '' THEN 'unclassified' ELSE {SQL_ROLE} END AS role FROM part) p ON p.role = v.role GROUP BY v.role")
def role_counts(spark, sf_dir):
    return graph.role_counts(parts(spark, sf_dir))


@query("""SELECT p_partkey AS work_id FROM part WHERE (p_partkey % 97 = 0 OR p_partkey % 3 = 0) AND p_partkey % 5 <> 0
    ORDER BY (p_partkey % 97 = 0) DESC, CASE WHEN p_partkey % 97 <> 0 THEN floor(p_retailprice) END DESC NULLS LAST, p_partkey LIMIT 25""")
def seed_candidates(spark, sf_dir):
    p = parts(spark, sf_dir)
    return graph.seeds(p, p.where("work_id % 5 = 0").select("work_id"), 25).select("work_id")


def _conflict_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").cast("string").alias("cite_key"), F.col("l_suppkey").alias("position"), F.col("l_quantity").cast("string").alias("quantity"), F.col("l_partkey").cast("string").alias("part"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("line"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_suppkey")).alias("at"))


@query("""SELECT 'quantity' AS field, part, flag, status, rows, papers, low, high, high / low AS ratio FROM (
    SELECT CAST(l_partkey AS VARCHAR) AS part, lower(l_returnflag) AS flag, lower(l_linestatus) AS status, count(*) AS rows, count(DISTINCT l_suppkey) AS papers, min(l_quantity) AS low, max(l_quantity) AS high,
    arg_min(l_suppkey, l_quantity * 1e9 + l_suppkey) AS low_key, arg_max(l_suppkey, l_quantity * 1e9 + l_suppkey) AS high_key FROM lineitem WHERE l_quantity > 0 GROUP BY ALL)
    WHERE papers >= 2 AND low_key <> high_key AND high / low >= 3.0""")
def conflict_groups(spark, sf_dir):
    found = evidence.conflicts(_conflict_rows(spark, sf_dir), ["quantity"], ["part", "flag", "status"])
    return found.select("field", "part", "flag", "status", "rows", "papers", "low", "high", "ratio")


@query("""WITH c AS (SELECT l_suppkey AS k, (l_orderkey * 10 + l_linenumber) * 1000000 + l_suppkey AS position, l_partkey AS part, lower(l_returnflag) AS flag, lower(l_linestatus) AS status, CAST(l_quantity AS DOUBLE) AS q FROM lineitem WHERE l_quantity > 0),
    g AS (SELECT part, flag, status, count(*) AS rows, count(DISTINCT k) AS papers, arg_min({'k': k, 'q': q}, {'q': q, 'p': position}) AS low, arg_max({'k': k, 'q': q}, {'q': q, 'p': position}) AS high FROM c GROUP BY ALL)
    SELECT part, flag, status, '## quantity -- part=' || part || ', flag=' || flag || ', status=' || status || chr(10) || chr(10) || rows || ' row(s) from ' || papers || ' paper(s) span ' || low.q::INT || ' to ' || high.q::INT AS opening,
        '| low | ' || low.k || ' | ' || low.q || ' | - | at ' || low.q || '/' || low.k || ' |' || chr(10) || '| high | ' || high.k || ' | ' || high.q || ' | - | at ' || high.q || '/' || high.k || ' |' AS ends
    FROM g WHERE papers >= 2 AND low.k <> high.k AND high.q / low.q >= 3""")
def conflicts_report(spark, sf_dir):
    rows = _conflict_rows(spark, sf_dir).withColumn("position", F.col("at")).withColumn("source_quote", F.concat(F.lit("at "), "quantity", F.lit("|"), "cite_key"))
    lines = reports.conflict_rows(evidence.conflicts(rows, ["quantity"], ["part", "flag", "status"]), ["part", "flag", "status"])
    opening = F.substring_index("line", " (", 1)  # the ratio's last digit is rounded as a double, which SQL does not do
    return lines.select(F.col("place.part").cast("long").alias("part"), "place.flag", "place.status", opening.alias("opening"), F.concat(F.lit("| low"), F.substring_index("line", "\n| low", -1)).alias("ends"))


@query("""SELECT unnest(['quantity', 'part', 'flag', 'status', 'receipt', 'blank']) AS field, unnest([bool_and(regexp_matches(CAST(l_quantity AS VARCHAR), n)), bool_and(regexp_matches(CAST(l_partkey AS VARCHAR), n)), bool_and(regexp_matches(l_returnflag, n)), bool_and(regexp_matches(l_linestatus, n)),
    bool_and(regexp_matches(CASE WHEN l_linenumber = 7 THEN 'ca. ' || l_suppkey WHEN l_linenumber = 6 THEN '' ELSE '~' || l_suppkey || ' %' END, n)) FILTER (l_linenumber <> 6), false]) AS quantity FROM lineitem, (SELECT '^[<>~=\\s]*[-+]?[0-9]+([.,][0-9]+)?(\\s*[eE][-+]?[0-9]+)?[\\s%]*$' AS n)""")
def quantity_columns(spark, sf_dir):
    receipt = F.when(F.col("line") == 7, F.concat(F.lit("ca. "), "cite_key")).when(F.col("line") == 6, "").otherwise(F.concat(F.lit("~"), "cite_key", F.lit(" %")))
    rows = _conflict_rows(spark, sf_dir).withColumn("receipt", receipt).withColumn("blank", F.lit(""))
    return evidence.column_kinds(rows, ["quantity", "part", "flag", "status", "receipt", "blank"])


def _cells(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("whole", F.floor(F.abs("value")).cast("long").cast("string"))
    cell = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("<"), "whole", F.lit(",5"))).when(F.col("event_id") % 5 == 1, F.concat(F.lit("~"), "whole", F.lit(" %"))).when(F.col("event_id") % 5 == 2, F.col("event_type")).when(F.col("event_id") % 5 == 3, F.concat("whole", F.lit(" us"))).otherwise(F.col("whole"))
    return e.select("event_id", "whole", cell.alias("cell"))


_SQL_CELLS = """SELECT event_id, w AS whole, CASE event_id % 5 WHEN 0 THEN '<' || w || ',5' WHEN 1 THEN '~' || w || ' %' WHEN 2 THEN event_type WHEN 3 THEN w || ' us' ELSE w END AS cell
    FROM (SELECT *, CAST(CAST(floor(abs(value)) AS BIGINT) AS VARCHAR) AS w FROM events)"""


@query(f"""SELECT event_id, ok AS is_number, CASE WHEN ok THEN TRY_CAST(replace(replace(regexp_extract(cell, '[-+]?[0-9]+(?:[.,][0-9]+)?(?:\\s*[eE][-+]?[0-9]+)?'), ',', '.'), ' ', '') AS DOUBLE) END AS number
    FROM (SELECT *, coalesce(regexp_matches(cell, '^[<>~=\\s]*[-+]?[0-9]+([.,][0-9]+)?(\\s*[eE][-+]?[0-9]+)?[\\s%]*$'), false) AS ok FROM ({_SQL_CELLS}))""")
def numeric_cell(spark, sf_dir):
    return _cells(spark, sf_dir).select("event_id", numeric.is_numeric(F.col("cell")).alias("is_number"), numeric.numeric_value(F.col("cell")).alias("number"))


def _quotes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("v", F.floor("o_totalprice").cast("long"))
    quote = F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.concat(F.lit("a total of "), F.when(F.col("o_orderkey") % 4 == 1, F.lit("7x")).otherwise(F.col("v").cast("string")), F.lit(" was seen")))
    return o.select(F.col("o_orderkey").cast("string").alias("cite_key"), F.lit("").alias("doi"), F.lit("").alias("year"), F.col("v").cast("string").alias("total"), F.col("o_orderstatus").alias("state"), quote.alias("source_quote"), F.lit("high").alias("confidence"), F.lit("").alias("note"))


_SQL_QUOTES = "SELECT CAST(o_orderkey AS VARCHAR) AS cite_key, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS total, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'a total of ' || CASE WHEN o_orderkey % 4 = 1 THEN '7x' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END || ' was seen' END AS source_quote FROM orders"
_SQL_SUPPORT = "contains(regexp_extract(source_quote, '[0-9]+'), rtrim(total, '0')) OR contains(rtrim(total, '0'), regexp_extract(source_quote, '[0-9]+'))"


@query(f"SELECT cite_key, coalesce(regexp_extract(source_quote, '[0-9]+') <> '' AND rtrim(regexp_extract(source_quote, '[0-9]+'), '0') <> '' AND (contains(rtrim(regexp_extract(source_quote, '[0-9]+'), '0'), rtrim(total, '0')) OR contains(rtrim(total, '0'), rtrim(regexp_extract(source_quote, '[0-9]+'), '0'))), false) AS supported FROM ({_SQL_QUOTES})")
def quote_support(spark, sf_dir):
    return _quotes(spark, sf_dir).select("cite_key", numeric.quote_supports(F.col("total"), F.col("source_quote")).alias("supported"))


@query(f"SELECT count(*) AS total, count(*) FILTER (source_quote <> '') AS accepted, count(*) FILTER (source_quote <> '' AND NOT (contains(rtrim(regexp_extract(source_quote, '[0-9]+'), '0'), rtrim(total, '0')) OR contains(rtrim(total, '0'), rtrim(regexp_extract(source_quote, '[0-9]+'), '0')))) AS flagged FROM ({_SQL_QUOTES})")
def evidence_validate(spark, sf_dir):
    return evidence.checked(_quotes(spark, sf_dir), ["total", "state"]).agg(F.count("*").alias("total"), F.count_if("accepted").alias("accepted"), F.count_if(F.array_contains("unsupported", "total")).alias("flagged"))


@query(f"SELECT cite_key, total, source_quote FROM ({_SQL_QUOTES}) WHERE source_quote <> ''")
def evidence_csv(spark, sf_dir):
    return evidence.evidence_csv(_quotes(spark, sf_dir), ["total", "state"]).select("cite_key", "total", "source_quote")


@query(f"SELECT doc_id AS work_id, array_to_string(list_slice(string_split({SQL_TITLE}, ' '), 1, 4), ' ') AS sum FROM documents")
def checksum_words(spark, sf_dir):
    return works(spark, sf_dir).select("work_id", T.checksum(F.col("title")).alias("sum"))


def _screened(spark, sf_dir):
    w = works(spark, sf_dir).select("work_id", "position", "title", F.lit("").alias("screen"), F.lit("").alias("screen_reason"), F.lit("").alias("role"))
    labels = table(spark, sf_dir, "labels").join(w, F.col("doc_id") == F.col("work_id"))
    index = F.when(F.col("doc_id") % 11 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id"))
    v = labels.select(index.alias("index"), F.col("doc_id").alias("from"), F.when(F.col("doc_id") % 13 == 0, "").otherwise(T.checksum(F.col("title"))).alias("t"), F.when(F.col("quality") == 1, "include").otherwise("exclude").alias("verdict"), F.lit("label").alias("reason"), F.when(F.col("toxic") == 1, "method").otherwise("").alias("role"))
    # of equal echoes at a place the earlier document's stays, as in the order that SQL meets them
    return w, v.groupBy("index").agg(F.max_by(F.struct("t", "verdict", "reason", "role"), F.struct("t", -F.col("from"))).alias("r")).select("index", "r.*")


@query(None)
def verdict_align_fuzzy(spark, sf_dir):
    w, v = _screened(spark, sf_dir)
    return screening.verdict_counts(screening.align(w, v))


@query(f"""WITH w AS (SELECT doc_id AS position, {SQL_TITLE} AS title, array_to_string(list_slice(string_split({SQL_TITLE}, ' '), 1, 4), ' ') AS c FROM documents),
    raw AS (SELECT CASE WHEN l.doc_id % 11 = 0 THEN l.doc_id + 1 ELSE l.doc_id END AS i, CASE WHEN l.doc_id % 13 = 0 THEN '' ELSE c END AS t, CASE WHEN quality = 1 THEN 'include' ELSE 'exclude' END AS verdict, CASE WHEN toxic = 1 THEN 'method' ELSE '' END AS role FROM labels l JOIN w ON w.position = l.doc_id),
    v AS (SELECT i, arg_max(struct_pack(t := t, verdict := verdict, role := role), t) AS r FROM raw GROUP BY i),
    f AS (SELECT v.i, v.r, v.r.t = '' AS blank, v.r.t = '' OR coalesce(w.title = v.r.t OR starts_with(w.title, v.r.t || ' '), false) AS fits FROM v LEFT JOIN w ON w.position = v.i),
    u AS (SELECT c, min(position) AS dest FROM w GROUP BY c HAVING count(*) = 1),
    m AS (SELECT u.dest, max(f.i) AS src, arg_max(f.r, f.i) AS r FROM f JOIN u ON u.c = f.r.t WHERE NOT f.fits GROUP BY u.dest),
    s AS (SELECT f.* FROM f WHERE f.i NOT IN (SELECT src FROM m)),
    o AS (SELECT w.position, s.r IS NOT NULL AS there, s.fits, s.blank, m.r IS NOT NULL AS moved, CASE WHEN m.r IS NOT NULL THEN m.r WHEN s.fits THEN s.r END AS r FROM w LEFT JOIN s ON s.i = w.position LEFT JOIN m ON m.dest = w.position)
    SELECT count(*) FILTER (r.verdict = 'include') AS include, count(*) FILTER (r.verdict = 'exclude') AS exclude, count(*) FILTER (r IS NULL) AS unscreened, count(*) FILTER (there AND NOT moved AND NOT fits) AS misaligned, count(*) FILTER (NOT moved AND fits AND blank) AS unverified, count(*) FILTER (moved) AS realigned, count(*) FILTER (coalesce(r.role, '') <> '') AS roled FROM o""")
def verdict_align(spark, sf_dir):
    w, v = _screened(spark, sf_dir)
    return screening.verdict_counts(screening.align(w, v, screening.echo_matches_exactly)).select("include", "exclude", "unscreened", "misaligned", "unverified", "realigned", "roled")


@query(f"SELECT k // 25 AS batch, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM ({_SQL_TRIAGED}) WHERE reason = '') GROUP BY 1")
def screen_batches(spark, sf_dir):
    survivors = triaged(spark, sf_dir).where("triage_verdict = 'needs_ai'").withColumn("year", F.lit(""))
    return screening.batches(survivors).groupBy("batch").agg(F.count("*").alias("n"), F.min("position").alias("first"), F.max("position").alias("last"))


@query("SELECT d.doc_id AS work_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL")
def review_queue(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("work_id"), F.lit("include").alias("screen"))
    return screening.review_queue(works(spark, sf_dir).join(labels, "work_id", "left")).select("work_id")


@query(f"""SELECT l.doc_id AS work_id, {SQL_TITLE} AS title, 'work' || CASE WHEN l.doc_id < 100 THEN lpad(CAST(l.doc_id AS VARCHAR), 3, '0') ELSE CAST(l.doc_id AS VARCHAR) END AS cite_key, CASE WHEN l.doc_id % 4 = 0 THEN 'https://x/' || l.doc_id ELSE '' END AS pdf_url,
    CASE WHEN l.doc_id % 3 = 0 THEN 'https://arxiv.org/pdf/' || l.doc_id ELSE '' END AS arxiv_pdf_url, CASE WHEN l.doc_id % 4 = 0 OR l.doc_id % 3 = 0 THEN 'true' ELSE 'false' END AS has_open_access_pdf FROM labels l JOIN documents d USING (doc_id) WHERE quality = 1 AND l.doc_id % 2 = 0""")
def extraction_tasks(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("work_id"), F.when(F.col("quality") == 1, "include").otherwise("exclude").alias("screen"), F.when(F.col("doc_id") % 2 == 0, "verified").otherwise("quarantined").alias("validation"))
    k = F.col("work_id")
    w = works(spark, sf_dir).join(labels, "work_id").withColumns({"doi": F.lit(None).cast("string"), "arxiv_id": F.when(k % 3 == 0, k.cast("string")), "oa_pdf_url": F.when(k % 4 == 0, F.concat(F.lit("https://x/"), k.cast("string"))), "year": F.lit(""), "screen_reason": F.lit("")})
    tasks = screening.extraction_tasks(w, ["gate"])
    return tasks.select("work_id", *[F.get_json_object("task", f"$.{c}").alias(c) for c in ("title", "cite_key", "pdf_url", "arxiv_pdf_url", "has_open_access_pdf")])


def _gold(spark, sf_dir):
    """The parts as gold papers, spelled in two ways; two of three as works, every fourth of them twice with another verdict later."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    gold = p.select(k.alias("key"), F.concat(F.when(k % 2 == 0, "https://doi.org/10.1234/B").otherwise("doi:10.1234/b"), k.cast("string")).alias("doi"), F.col("p_name").alias("title"))
    first = p.where(k % 3 != 0).select(F.concat(F.lit("10.1234/b"), k.cast("string")).alias("doi"), F.when(k % 2 == 0, "include").when(k % 5 == 0, "unsure").otherwise("").alias("screen"), F.col("p_brand").alias("validation"), k.cast("long").alias("position"))
    later = first.where(F.col("position") % 4 == 0).select("doi", F.when(F.col("position") % 8 == 0, "exclude").otherwise("").alias("screen"), F.lit("").alias("validation"), (F.col("position") + 1_000_000_000_000).alias("position"))
    return screening.gold_recall(gold, first.unionByName(later))


_SQL_GOLD = """SELECT p_partkey AS key, p_partkey % 3 <> 0 AS found, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 4 = 0 THEN '' ELSE p_brand END AS validation,
    CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 8 = 0 THEN 'exclude' WHEN p_partkey % 4 = 0 THEN 'unscreened' WHEN p_partkey % 2 = 0 THEN 'include' WHEN p_partkey % 5 = 0 THEN 'unsure' ELSE 'unscreened' END AS screen FROM part"""


@query(_SQL_GOLD)
def gold_recall(spark, sf_dir):
    return _gold(spark, sf_dir).select("key", "found", "screen", "validation")


@query(f"SELECT count(*) AS total, count(*) FILTER (found) AS found, count(*) FILTER (screen IN ('exclude', 'unsure')) AS found_but_screened_out, round(100.0 * count(*) FILTER (found) / count(*), 1) AS recall_pct FROM ({_SQL_GOLD})")
def gold_summary(spark, sf_dir):
    return screening.gold_summary(_gold(spark, sf_dir))


@query(f"SELECT key, CASE WHEN NOT found THEN 'missed' ELSE 'screened_out' END AS failure FROM ({_SQL_GOLD}) WHERE NOT found OR screen IN ('exclude', 'unsure')")
def gold_missed(spark, sf_dir):
    return screening.gold_missed(_gold(spark, sf_dir))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Doe' ELSE 'de' || split_part(p_type, ' ', 1) END AS surname FROM part")
def surname_key(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    names = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Doe, "), "p_brand", F.lit(" and Roe, J"))).otherwise(F.concat("p_brand", F.lit(" de "), F.substring_index("p_type", " ", 1)))
    return p.select("p_partkey", T.surname_udf(names).alias("surname"))


@query("SELECT 'k' || CAST(p_partkey % 500 AS VARCHAR) AS key, count(*) - 1 AS n FROM part GROUP BY p_partkey % 500 HAVING count(*) > 1")
def dup_keys(spark, sf_dir):
    e = _entries(spark, sf_dir).withColumn("key", F.concat(F.lit("k"), (F.col("node_pos") % 500).cast("string")))
    return bib.duplicate_findings(e).where("code = 'duplicate-key'").groupBy("key").agg(F.count("*").alias("n"))


@query("SELECT 's' || s_suppkey AS key, '@misc{s' || s_suppkey || ',' || chr(10) || '    title = {' || s_name || '},' || chr(10) || '    note  = {' || s_nationkey || '}' || chr(10) || '}' AS line FROM supplier")
def bib_layout(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    f = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("text"), F.lit("brace").alias("delim"))
    kind, none = F.lit("misc").alias("type"), F.lit(None).cast("string")
    nodes = s.select(F.lit("f").alias("file"), F.col("s_suppkey").cast("int").alias("node_pos"), F.lit("entry").alias("kind"), kind, F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("key"), F.lit(0).alias("section_id"), F.lit(False).alias("is_banner"), none.alias("text"), none.alias("lead_comment"), F.array(f("note", F.col("s_nationkey")), f("title", F.col("s_name"))).alias("fields"))
    return export.laid_out(nodes, "global").select(F.col("place.key").alias("key"), "line")


@query("SELECT CAST(s_nationkey AS VARCHAR) AS file, CAST(count(*) AS VARCHAR) AS entry_count, CAST(count(*) FILTER (s_suppkey % 3 = 0) AS VARCHAR) AS errors, CASE WHEN count(*) FILTER (s_suppkey % 3 = 0) > 0 THEN '2' ELSE '0' END AS exit_code, CAST(min(s_suppkey) FILTER (s_suppkey % 3 <= 1) AS VARCHAR) AS any_key FROM supplier GROUP BY s_nationkey")
def lint_json(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("file"), k.cast("string").alias("key"), k)
    found = s.where(k % 3 <= 1).select("file", "key", F.lit(1).alias("line"), F.when(k % 3 == 0, "error").otherwise("info").alias("level"), F.lit("c").alias("code"), F.lit("m").alias("message"))
    out = reports.json_reports(found, s).withColumn("keys", F.from_json(F.get_json_object("report", "$.findings[*].key"), "array<string>"))
    of = lambda path: F.get_json_object("report", path)
    return out.select("file", of("$.entry_count").alias("entry_count"), of("$.counts.error").alias("errors"), of("$.exit_code").alias("exit_code"), F.array_min(F.transform(F.coalesce("keys", F.array(of("$.findings[0].key"))), lambda x: x.cast("long"))).cast("string").alias("any_key"))


@query(None)
def known_items(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", title_of().alias("title"))
    return screening.known_items(items, works(spark, sf_dir))


_DOI = "CASE p_partkey % 5 WHEN 0 THEN 'https://doi.org/10.' WHEN 1 THEN 'doi:10.' WHEN 2 THEN ' 10.' WHEN 3 THEN 'ftp://10.' ELSE '10.48550/arXiv.' END || lpad(CAST(p_partkey AS VARCHAR), 6, '1') || '/' || p_brand"


def _identified(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 5
    prefix = F.when(k == 0, "https://doi.org/10.").when(k == 1, "doi:10.").when(k == 2, " 10.").when(k == 3, "ftp://10.").otherwise("10.48550/arXiv.")
    return p.select("p_partkey", F.concat(prefix, F.lpad(F.col("p_partkey").cast("string"), 6, "1"), F.lit("/"), F.col("p_brand")).alias("raw"))


@query(f"""SELECT p_partkey, CASE WHEN starts_with(b, '10.') THEN b END AS doi, coalesce(regexp_matches(lower(r), '^10\\.48550/arxiv\\.'), false) AS arxiv, coalesce(split_part(CASE WHEN starts_with(b, '10.') THEN b END, '/', 1) IN ('10.5281', '10.48550', '10.3929', '10.5061', '10.17632', '10.15468'), false) AS repository
    FROM (SELECT p_partkey, r, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(r)), '^https://doi.org/', ''), '^http://doi.org/', ''), '^doi:', '')) AS b FROM (SELECT p_partkey, {_DOI} AS r FROM part))""")
def doi_clean(spark, sf_dir):
    d = _identified(spark, sf_dir).withColumn("doi", T.clean_doi(F.col("raw")))
    return d.select("p_partkey", "doi", T.is_arxiv_doi(F.col("raw")).alias("arxiv"), T.is_repository_doi(F.col("doi")).alias("repository"))


@query("""SELECT p_partkey, nullif(regexp_extract(r, '[0-9]{4}\\.[0-9]{4,5}'), '') AS id, CASE WHEN p_partkey % 2 = 0 THEN coalesce(CAST(CASE WHEN CAST(substr(i, 1, 2) AS INT) >= 7 THEN 2000 + CAST(substr(i, 1, 2) AS INT) END AS VARCHAR), '') ELSE '' END AS year
    FROM (SELECT p_partkey, lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') || '.12345' AS i, CASE WHEN p_partkey % 2 = 0 THEN 'https://arxiv.org/abs/' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') || '.12345v2' ELSE 'no id here' END AS r FROM part)""")
def arxiv_id_extract(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("https://arxiv.org/abs/"), F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"), F.lit(".12345v2"))).otherwise("no id here").alias("raw"))
    return p.withColumn("id", T.clean_arxiv_id(F.col("raw"))).select("p_partkey", "id", T.year_from_arxiv_id(F.col("id")).alias("year"))


_SQL_FOLDED = "regexp_replace(strip_accents(replace(replace(replace(text, 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe')), '[^\\x00-\\x7F]', '', 'g')"


@query(f"SELECT doc_id, trim(regexp_replace(lower({_SQL_FOLDED}), '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents")
def normalize_title_ascii(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_title(F.col("text")).alias("norm"))


@query(f"SELECT doc_id, trim(regexp_replace({_SQL_FOLDED}, '\\s+', ' ', 'g')) AS folded FROM documents")
def fold_unicode(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.fold_udf("text").alias("folded"))


@query("""SELECT s_suppkey AS work_id, b || CASE WHEN count(*) OVER (PARTITION BY b) = 1 THEN '' ELSE CASE WHEN k < 26 THEN chr(97 + k) ELSE chr(96 + k // 26) || chr(97 + k % 26) END END AS new_key FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY b ORDER BY s_suppkey) - 1 AS INT) AS k FROM (SELECT s_suppkey, 'Name' || CAST(1900 + s_nationkey * 4 + s_suppkey % 4 AS VARCHAR) AS b FROM supplier))""")
def collision_suffix(spark, sf_dir):
    s, f = table(spark, sf_dir, "supplier"), lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("text"))
    year, n = (F.lit(1900) + F.col("s_nationkey") * 4 + F.col("s_suppkey") % 4).cast("string"), F.col("s_suppkey").cast("string")
    fields = F.array(f("author", F.lit("Name, A.")), f("year", year), f("title", F.lpad(n, 12, "0")))
    e = s.select(F.lit("f").alias("file"), F.col("s_suppkey").alias("work_id"), F.col("s_suppkey").alias("node_pos"), n.alias("key"), fields.alias("fields"))
    return bib.keyed(e).select("work_id", "new_key")


def _entries(spark, sf_dir):
    """One entry a part, some fields blank or malformed by key."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    fields = [("author", F.concat(F.lit("Smith, "), "p_brand"), k % 7 != 0), ("title", F.when(k % 11 == 0, F.lit("to verify")).otherwise(F.col("p_name")), k % 5 != 0), ("year", F.when(k % 3 == 0, F.concat(F.lit("in "), (F.lit(1950) + F.col("p_size")).cast("string"))).otherwise((F.lit(1950) + F.col("p_size")).cast("string")), k % 13 != 0), ("journal", F.lit("Journal"), k % 4 != 0), ("doi", F.concat(F.when(k % 6 == 0, F.lit("bad")).otherwise(F.lit("10.1234/")), k.cast("string")), k % 2 == 0), ("pages", F.lit("1-9"), k % 9 != 0)]
    array = F.array_compact(F.array(*[F.when(put, F.struct(F.lit(n).alias("name"), v.alias("text"), F.lit("brace").alias("delim"))) for n, v, put in fields]))
    kind = F.when(k % 10 == 0, "book").otherwise("article")
    return p.select(F.lit("parts").alias("file"), k.cast("int").alias("node_pos"), kind.alias("type"), kind.alias("type_raw"), F.concat(F.lit("k"), k.cast("string")).alias("key"), F.lit(1).alias("line"), array.alias("fields"))


_SQL_PARTS = "SELECT *, 'k' || CAST(p_partkey AS VARCHAR) AS key, p_partkey AS k, p_partkey % 10 = 0 AS book FROM part"


@query(f"""SELECT key, 'error' AS level, 'author' AS field FROM ({_SQL_PARTS}) WHERE k % 7 = 0 UNION ALL SELECT key, 'error', 'title' FROM ({_SQL_PARTS}) WHERE k % 5 = 0 UNION ALL SELECT key, 'error', 'year' FROM ({_SQL_PARTS}) WHERE k % 13 = 0
    UNION ALL SELECT key, 'error', 'publisher' FROM ({_SQL_PARTS}) WHERE book UNION ALL SELECT key, 'warning', 'journal' FROM ({_SQL_PARTS}) WHERE NOT book AND k % 4 = 0 UNION ALL SELECT key, 'warning', 'volume' FROM ({_SQL_PARTS}) WHERE NOT book
    UNION ALL SELECT key, 'warning', 'pages' FROM ({_SQL_PARTS}) WHERE NOT book AND k % 9 = 0 UNION ALL SELECT key, 'warning', 'doi' FROM ({_SQL_PARTS}) WHERE k % 2 <> 0""")
def lint_required(spark, sf_dir):
    found = bib.findings(_entries(spark, sf_dir)).where(F.col("code").isin("missing-field", "missing-recommended"))
    return found.select("key", "level", F.substring_index("message", " ", -1).alias("field"))


@query(f"""SELECT key, 'bad-year' AS code, 'warning' AS level FROM ({_SQL_PARTS}) WHERE k % 3 = 0 AND k % 13 <> 0 UNION ALL SELECT key, 'bad-doi', 'error' FROM ({_SQL_PARTS}) WHERE k % 2 = 0 AND k % 6 = 0
    UNION ALL SELECT key, 'placeholder', 'error' FROM ({_SQL_PARTS}) WHERE k % 11 = 0 AND k % 5 <> 0""")
def lint_values(spark, sf_dir):
    return bib.findings(_entries(spark, sf_dir)).where(F.col("code").isin("bad-year", "bad-doi", "placeholder")).select("key", "code", "level")


@query("""SELECT p_partkey AS key, 'page-range' AS code, 'info' AS level, 'page range ' || p_size || '-' || (p_size + 9) || ' normalised to ' || p_size || '--' || (p_size + 9) AS message FROM part WHERE p_partkey % 2 = 0
    UNION ALL SELECT p_partkey, 'doi-prefix', 'info', 'stripped resolver prefix from doi -> 10.1234/' || p_partkey FROM part WHERE p_partkey % 3 = 0
    UNION ALL SELECT p_partkey, 'doi-from-url', 'info', 'recovered doi 10.5555/' || p_partkey || ' from the url field' FROM part WHERE p_partkey % 3 = 1
    UNION ALL SELECT p_partkey, 'arxiv-relocated', 'info', 'moved arXiv id 2001.' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 5, '0') || ' from journal into eprint/archivePrefix' FROM part WHERE p_partkey % 5 = 0""")
def normalization_changes(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    n, size = k.cast("string"), F.col("p_size")
    pages = F.concat(size.cast("string"), F.when(k % 2 == 0, "-").otherwise("--"), (size + 9).cast("string"))
    fields = [("journal", F.when(k % 5 == 0, F.concat(F.lit("arXiv:2001."), F.lpad((k % 10000).cast("string"), 5, "0"))).otherwise("J"), F.lit(True)), ("pages", pages, F.lit(True)), ("doi", F.concat(F.lit("https://doi.org/10.1234/"), n), k % 3 == 0), ("url", F.concat(F.lit("https://doi.org/10.5555/"), n), k % 3 == 1)]
    array = F.array_compact(F.array(*[F.when(put, F.struct(F.lit(name).alias("name"), v.alias("text"), F.lit("brace").alias("delim"))) for name, v, put in fields]))
    e = p.select(F.lit("parts").alias("file"), k.alias("key"), F.lit(1).alias("line"), array.alias("fields"))
    return bib.changes(e).select("key", "code", "level", "message")


_MARKED = "text || CASE doc_id % 8 WHEN 0 THEN ' ToDo' WHEN 1 THEN ' mastodon' WHEN 2 THEN '. To be  confirmed' WHEN 3 THEN '(to VERIFY)' WHEN 4 THEN ' x??? ' WHEN 5 THEN ' xxxx' ELSE '' END"


@query(f"SELECT doc_id FROM documents WHERE regexp_matches({_MARKED}, '(?i)\\b(to verify|to be verified|not confirmed|to be confirmed|tbd|todo|fixme|placeholder|fill in|xxx)\\b|\\?\\?\\?')")
def placeholder_scan(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("v", F.expr(_MARKED))
    return d.where(T.has_placeholder(F.col("v"))).select("doc_id")


@query("SELECT CAST(doc_id AS VARCHAR) AS file, CAST(k AS INT) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents) WHERE regexp_matches(x, '[^\\x00-\\x7F]')")
def non_ascii_lines(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), F.col("text").alias("source"))
    return bib.non_ascii_findings(files).where("code = 'non-ascii'").select("file", "line")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k > 1")
def dup_entries(spark, sf_dir):
    doi = F.concat(F.lit("10.1234/"), F.sha2(F.col("text").cast("binary"), 256))
    fields = F.array(F.struct(F.lit("doi").alias("name"), doi.alias("text")))
    e = table(spark, sf_dir, "documents").select(F.lit("f").alias("file"), F.col("doc_id").alias("node_pos"), F.col("doc_id").cast("string").alias("key"), F.lit(0).alias("line"), fields.alias("fields"))
    return bib.duplicate_findings(e).where("code = 'duplicate-entry'").select(F.col("key").cast("long").alias("doc_id"))


@query("SELECT min(doc_id) AS position, count(*) AS n FROM documents GROUP BY text")
def exact_dedup(spark, sf_dir):
    same = {"doi": F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), "title": F.lit("?"), "arxiv_id": F.lit(""), "year": F.lit(""), "authors": F.array().cast("array<string>")}
    found = corpus.clusters(table(spark, sf_dir, "documents").withColumn("position", F.col("doc_id")).withColumns(same))
    return found.groupBy(F.col("cluster").alias("position")).agg(F.count("*").alias("n"))


@query(f"""WITH t AS (SELECT DISTINCT {SQL_TITLE} AS t FROM documents), c AS (SELECT t, length(t) AS n, {', '.join(f"length(t) - length(replace(t, '{s}', '')) AS c{i}" for i, s in enumerate(dedup.SYMBOLS))} FROM t WHERE t <> '')
    SELECT a.t AS a, b.t AS b FROM c a JOIN c b ON a.t < b.t AND 2 * least(a.n, b.n) >= 0.92 * (a.n + b.n) AND 2 * ({' + '.join(f'least(a.c{i}, b.c{i})' for i in range(len(dedup.SYMBOLS)))}) >= 0.92 * (a.n + b.n)""")
def dedup_candidates(spark, sf_dir):
    return dedup.title_candidates(works(spark, sf_dir))


def _full_works(spark, sf_dir):
    blank = {c: F.lit("") for c in ("year", "volume", "pages", "oa_pdf_url", "landing_url", "screen", "screen_reason", "role", "validation", "validation_source")}
    more = {"doi": F.lit(None).cast("string"), "arxiv_id": F.lit(None).cast("string"), "authors": F.array().cast("array<string>"), "references": F.array().cast("array<string>"), "sources": F.array("venue"), "source_ids": F.create_map("venue", F.col("work_id").cast("string")), "cited_by_count": F.length("title"), "found_in_round": F.lit(0), "is_seed": F.lit(False)}
    return works(spark, sf_dir).withColumns(blank | more)


WORK_TYPES = "position long, work_id long, title string, abstract string, venue string, year string, volume string, pages string, oa_pdf_url string, landing_url string, screen string, screen_reason string, role string, validation string, validation_source string, doi string, arxiv_id string, authors array<string>, references array<string>, sources array<string>, source_ids map<string,string>, cited_by_count int, found_in_round int, is_seed boolean"


def identified_works(spark, sf_dir):
    """The documents as works with shared and rival identifiers: DOIs and arXiv ids by text, source and number, some of arXiv's own."""
    k, h = F.col("work_id"), F.crc32(F.col("title").cast("binary"))
    doi = F.when(k % 5 == 0, F.concat(F.lit("10.1234/"), h.cast("string"))).when(k % 5 == 1, F.concat(F.lit("10.1234/"), k.cast("string"))).when(k % 5 == 2, F.concat(F.lit("10.48550/arxiv."), k.cast("string"))).otherwise("")
    arxiv = F.when(k % 7 == 0, (h % 1000).cast("string")).when(k % 7 == 1, k.cast("string"))
    changed = {"doi": doi, "arxiv_id": arxiv, "year": F.when(k % 3 == 0, "").otherwise((F.lit(2000) + h % 3).cast("string")), "authors": F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("Doe, "), F.col("venue"))))}
    return _full_works(spark, sf_dir).withColumns(changed)


@query(None)
def corpus_replay(spark, sf_dir):
    return corpus.clusters(identified_works(spark, sf_dir))


@query(None)
def fuzzy_dedup(spark, sf_dir):
    return corpus.deduplicated(_full_works(spark, sf_dir).withColumn("abstract", F.lit(""))).select("position", "title", "sources")


@query(f"SELECT min(doc_id) AS position, arg_max(CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END, CASE WHEN doc_id % 2 = 0 THEN -doc_id ELSE -1e15 - doc_id END) AS venue, max(length({SQL_TITLE})) AS cited_by_count, len(list_distinct(list(source))) AS sources FROM documents GROUP BY text")
def merge_records(spark, sf_dir):
    w = _full_works(spark, sf_dir).withColumn("sources", F.array("venue")).withColumn("venue", F.when(F.col("work_id") % 2 == 0, F.col("venue")).otherwise(""))
    h = F.sha2(F.col("abstract").cast("binary"), 256)
    cluster = w.select("position", h.alias("h")).join(w.groupBy(h.alias("h")).agg(F.min("position").alias("cluster")), "h").select("position", "cluster")
    m = dedup.merged(w.withColumn("abstract", F.lit("")), cluster)
    return m.select("position", "venue", F.col("cited_by_count").cast("long").alias("cited_by_count"), F.size("sources").cast("long").alias("sources"))


@query(f"""WITH d AS (SELECT doc_id, list_distinct(string_split({SQL_TITLE}, ' ')) AS t FROM documents), p AS (SELECT doc_id, len(t) FILTER (t <> ['']) AS n, unnest(t) AS term FROM d), x AS (SELECT doc_id, n, term FROM p WHERE term <> ''),
    w AS (SELECT term, CAST(round(1e6 * ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5))) AS BIGINT) AS w FROM x GROUP BY term)
    SELECT a.doc_id AS query_id, CAST(row_number() OVER (PARTITION BY a.doc_id ORDER BY sum(w) DESC, b.n, b.doc_id) AS INT) AS place, b.doc_id, CAST(sum(w) AS BIGINT) AS score
    FROM x a JOIN x b USING (term) JOIN w USING (term) WHERE a.doc_id % 20 = 0 GROUP BY a.doc_id, b.doc_id, b.n QUALIFY place <= 5""".replace("len(t) FILTER (t <> [''])", "len(list_filter(t, lambda x: x <> ''))"))
def title_search(spark, sf_dir):
    titles = works(spark, sf_dir).select(F.col("work_id").alias("doc_id"), F.col("title").alias("text"))
    return search.search(titles.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text"), search.Index(titles), 5)


def _gated(spark, sf_dir):
    w, k = works(spark, sf_dir), F.col("work_id")
    doi = F.when(k % 3 == 0, F.concat(F.lit("10.1234/"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("10.5281/"), k.cast("string")))
    w = w.where("title <> ''").withColumns({"doi": doi, "arxiv_id": F.lit(None).cast("string"), "year": F.lit(""), "volume": F.lit(""), "pages": F.lit(""), "authors": F.array().cast("array<string>")})
    title = F.when(k % 5 == 0, F.concat("title", F.lit(" altered"))).otherwise(F.col("title"))
    base = w.where(k % 7 != 0).select(F.when(k % 3 == 0, "crossref").when(k % 3 == 1, "datacite").otherwise("openalex").alias("source"), "doi", title.alias("title"), F.array(F.lit("Doe, J")).alias("authors"), F.lit("1999").alias("year"), F.lit("J").alias("journal"), k.cast("string").alias("volume"), F.lit("").alias("pages"), F.lit("").alias("url"))
    return gate.gate(w, base, exact_titles=True)


_SQL_GATE = f"""WITH w AS (SELECT doc_id AS k, {SQL_TITLE} AS t FROM documents WHERE {SQL_TITLE} <> ''), o AS (SELECT DISTINCT CASE WHEN k % 5 = 0 THEN t || ' altered' ELSE t END AS t FROM w WHERE k % 7 <> 0 AND k % 3 = 2),
    g AS (SELECT w.k, CASE WHEN w.k % 3 = 0 THEN w.k % 7 <> 0 AND w.k % 5 <> 0 WHEN w.k % 3 = 1 THEN w.k % 7 <> 0 ELSE o.t IS NOT NULL END AS ok, CASE WHEN w.k % 3 = 0 AND w.k % 7 <> 0 THEN 'crossref' WHEN w.k % 3 = 1 AND w.k % 7 <> 0 THEN 'datacite' WHEN w.k % 3 = 2 AND o.t IS NOT NULL THEN 'openalex' ELSE '' END AS src FROM w LEFT JOIN o ON o.t = w.t)"""


@query(f"{_SQL_GATE} SELECT k AS work_id, CASE WHEN ok THEN 'verified' ELSE 'quarantined' END AS validation, src AS validation_source FROM g")
def gate_status(spark, sf_dir):
    return _gated(spark, sf_dir).select("work_id", "validation", "validation_source")


@query(f"{_SQL_GATE} SELECT k AS work_id, CASE WHEN ok THEN '1999' ELSE '' END AS year, CASE WHEN ok THEN 1 ELSE 0 END AS n_authors FROM g")
def enrich_blank(spark, sf_dir):
    return gate.enriched(_gated(spark, sf_dir)).select("work_id", "year", F.size("authors").alias("n_authors"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def markup_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_markup(F.col("html")).alias("text"))


@query(f"SELECT doc_id AS work_id, {SQL_TITLE} AS text FROM documents")
def inverted_index(spark, sf_dir):
    w = works(spark, sf_dir).select("work_id", F.split("title", " ").alias("words"))
    inverted = F.map_from_entries(F.transform(F.array_distinct("words"), lambda x: F.struct(x, F.filter(F.transform(F.col("words"), lambda y, i: F.when(x == y, i)), lambda i: i.isNotNull()))))
    return w.select("work_id", payloads.words_in_order(inverted).alias("text"))


@query("SELECT s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier")
def bib_roundtrip(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    f = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("text"), F.lit("brace").alias("delim"))
    e = s.select(F.lit("misc").alias("type"), F.col("s_suppkey").cast("string").alias("key"), F.array(f("note", F.col("s_nationkey").cast("string")), f("title", F.col("s_name"))).alias("fields"))
    files = bib.rendered(e).select(F.col("key").alias("file"), F.col("bibtex").alias("source"))
    back = bib.parse_files(files).where("kind = 'entry'")
    return back.select(F.col("key").cast("long").alias("s_suppkey"), bib.field("title").alias("s_name"), bib.field("note").alias("nation"))


@query("""SELECT p_brand AS file, 'k' || p_partkey AS key, 'in {' || p_name || '}' AS title, CAST(p_size AS VARCHAR) AS size, CAST(5 * (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) + 2 AS INT) AS line,
    CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INT) AS node_pos, 'part ' || p_partkey AS note FROM part""")
def bib_chunks_parsed(spark, sf_dir):
    """One BibTeX file a brand, written from the parts and read back in chunks of 64 lines, which cut entries of five lines."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    lines = F.concat(F.lit("% part "), k, F.lit("\n@Misc{k"), k, F.lit(",\n  title = {in {"), "p_name", F.lit('}},\n  size = "'), F.col("p_size").cast("string"), F.lit('",\n}'))
    path = new_path(spark, "bib")
    brand = F.substring_index("p_brand", "#", -1).alias("brand")
    p.select(brand, "p_partkey", lines.alias("value")).repartition("brand").sortWithinPartitions("brand", "p_partkey").select("brand", "value").write.partitionBy("brand").text(path)
    nodes = bib_chunks.parse_chunks(bib_chunks.chunks(spark, path, rows=64)).where("kind = 'entry'")
    file = F.concat(F.lit("Brand#"), F.regexp_extract("file", "brand=([0-9]+)/", 1))
    return nodes.select(file.alias("file"), "key", bib.field("title").alias("title"), bib.field("size").alias("size"), "line", "node_pos", F.replace("lead_comment", F.lit("% "), F.lit("")).alias("note"))


_WINDOW = (2000, 2010)


def _answers(spark, sf_dir):
    """Requests to three indexes and the answers of a log recorded from the tables: OpenAlex answers with documents by their source,

    Semantic Scholar with parts by their brand, the third index was never recorded. Answers hold the 200 and 100 first items of the window.
    """
    low, high = _WINDOW
    d, p = table(spark, sf_dir, "documents"), table(spark, sf_dir, "part")
    year = (F.lit(1990) + F.col("doc_id") % 30).cast("int")
    alex = F.struct(
        F.concat(F.lit("https://openalex.org/W"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("https://doi.org/10.5/"), F.col("doc_id").cast("string")).alias("doi"), title_of().alias("display_name"), year.alias("publication_year"),
        F.array(F.struct(F.struct(F.col("lang").alias("display_name")).alias("author"))).alias("authorships"), F.col("n_chars").cast("int").alias("cited_by_count"),
    )
    scholar = F.struct(F.col("p_partkey").cast("string").alias("paperId"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("title"), (F.lit(1970) + F.col("p_size")).cast("int").alias("year"))
    asked = {
        "openalex": d.where(year.between(low, high) & F.col("source").isNotNull()).select(F.col("source").alias("asked"), F.col("doc_id").alias("k"), F.to_json(alex).alias("payload")),
        "semanticscholar": p.where((F.lit(1970) + F.col("p_size")).between(low, high)).select(F.col("p_brand").alias("asked"), F.col("p_partkey").alias("k"), F.to_json(scholar).alias("payload")),
    }
    root, requests = new_path(spark, "log"), []
    for source, found in asked.items():
        most = retrieval.MOST[source]
        placed = found.withColumn("place", F.row_number().over(Window.partitionBy("asked").orderBy("k")) - 1).where(F.col("place") < most)
        names = sorted(r["asked"] for r in found.select("asked").distinct().collect())  # the names of sources and brands
        requests += [retrieval.Request(source, "search", n, most) for n in names]
        key = F.concat(F.lit(f"{source}:search:"), "asked", F.lit(f":{low}:{high}:{most}"))
        retrieval.record(placed.select(key.alias("key"), "place", "payload"), root)
    requests.append(retrieval.Request("inspire", "search", "anything", 100))
    return written(retrieval.answers(spark, requests, root, low, high), "answers")


_SQL_ANSWERS = f"""SELECT 'openalex' AS source, source AS asked, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, {SQL_TITLE} AS title, CAST(1990 + doc_id % 30 AS VARCHAR) AS year, '10.5/' || doc_id AS doi, CAST(doc_id AS VARCHAR) AS id FROM documents
    WHERE 1990 + doc_id % 30 BETWEEN {_WINDOW[0]} AND {_WINDOW[1]} AND source IS NOT NULL QUALIFY place < 200
    UNION ALL SELECT 'semanticscholar', p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k, p_name || ' ' || p_partkey, CAST(1970 + p_size AS VARCHAR), NULL, CAST(p_partkey AS VARCHAR) FROM part WHERE 1970 + p_size BETWEEN {_WINDOW[0]} AND {_WINDOW[1]} QUALIFY k < 100"""


@query(f"SELECT s.source, count(DISTINCT asked) + CASE WHEN s.source = 'inspire' THEN 1 ELSE 0 END AS requests, count(asked) AS hits, CASE WHEN s.source = 'inspire' THEN 1 ELSE 0 END AS failed, count(asked) = 0 AS silent FROM (VALUES ('openalex'), ('semanticscholar'), ('inspire')) s(source) LEFT JOIN ({_SQL_ANSWERS}) a ON a.source = s.source GROUP BY s.source")
def retrieval_report(spark, sf_dir):
    return retrieval.report(_answers(spark, sf_dir)).drop("error")


@query(f"SELECT place, title, year, doi, source, CASE source WHEN 'openalex' THEN 'W' || id ELSE id END AS id FROM ({_SQL_ANSWERS})")
def retrieval_works(spark, sf_dir):
    works = retrieval.retrieved(_answers(spark, sf_dir), *_WINDOW)
    source = F.element_at("sources", 1)
    return works.select((F.col("position") % 1_000_000_000).alias("place"), "title", "year", "doi", source.alias("source"), F.element_at("source_ids", source).alias("id"))


def _response_log(spark, sf_dir):
    """A log over the orders: answers for even keys, later misses for every tenth, compacted, then newer answers for every twentieth."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    log = cache.ResponseLog(spark, new_path(spark, "responses"))
    key = cache.key_of("crossref:doi", F.concat(F.lit(" 10.1234/K"), k.cast("string"))).alias("key")
    log.append(o.where(k % 2 == 0).select(key, F.concat(F.lit("first "), F.col("o_orderstatus")).alias("payload")))
    log.append(o.where(k % 10 == 0).select(key, F.lit(None).cast("string").alias("payload")))
    log.compact()
    log.append(o.where(k % 20 == 0).select(key, F.lit("newer").alias("payload")))
    return log, o.select(k, key)


@query("SELECT o_orderkey, o_orderkey % 2 = 0 AS known, CASE WHEN o_orderkey % 20 = 0 THEN 'newer' WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'first ' || o_orderstatus END AS payload FROM orders")
def cache_lookup(spark, sf_dir):
    log, keys = _response_log(spark, sf_dir)
    return log.lookup(keys).select("o_orderkey", "known", "payload")


@query("SELECT b AS batch, least(50, n - 50 * b) AS keys FROM (SELECT count(*) AS n FROM orders WHERE o_orderkey % 2 <> 0), LATERAL (SELECT unnest(range(0, (n + 49) // 50)) AS b)")
def cache_batches(spark, sf_dir):
    log, keys = _response_log(spark, sf_dir)
    return cache.request_batches(log.unknown(keys)).select("batch", F.size("keys").cast("long").alias("keys"))


@query(f"""WITH t AS (SELECT doc_id, CASE WHEN reason <> '' THEN 1 ELSE 0 END AS rule FROM ({_SQL_TRIAGED})), w AS (SELECT d.doc_id, rule, {SQL_TITLE} AS title, CASE l.quality WHEN 1 THEN 'include' WHEN 0 THEN 'unsure' ELSE '' END AS screen, d.doc_id % 3 AS g,
        len(list_intersect(list_distinct(regexp_extract_all(lower({SQL_TITLE} || ' ' || coalesce(text, '')), '[a-z0-9]+')), {QUERY_TERMS!r})) >= 2 AS topical FROM documents d JOIN t USING (doc_id) LEFT JOIN labels l USING (doc_id)),
    i AS (SELECT DISTINCT title FROM w WHERE screen = 'include'), x AS (SELECT w.*, i.title IS NOT NULL AS hit FROM w LEFT JOIN i USING (title))
    SELECT count(*) AS corpus_size, count(*) FILTER (topical) AS topical_kept, count(*) FILTER (NOT topical) AS topical_dropped, count(*) FILTER (rule = 0) AS triage_to_model, count(*) FILTER (rule = 1) AS triage_by_rule, count(*) FILTER (rule = 1 AND hit) AS includes_lost_to_triage,
        count(*) FILTER (g = 0) AS gate_verified, count(*) FILTER (g = 1) AS gate_quarantined, count(*) FILTER (screen = 'include') AS screened_include, count(*) FILTER (screen = 'unsure') AS screened_unsure, count(*) FILTER (screen = 'include' AND g = 0 AND title <> '') AS bib_entries,
        count(*) FILTER (screen = 'include' AND g = 0 AND title <> '' AND doc_id % 2 = 0) AS bib_errors, (SELECT count(*) FROM benchmark) AS gold_total, (SELECT count(*) FROM benchmark WHERE item_id IN (SELECT doc_id FROM documents)) AS gold_found FROM x""")
def benchmark_metrics(spark, sf_dir):
    """Measures of the documents as a corpus of works without identifiers of their own titles' kind; dedup is asked for equal titles only."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("work_id"), F.when(F.col("quality") == 1, "include").otherwise("unsure").alias("screen"))
    k = F.col("work_id")
    own = {"validation": F.when(k % 3 == 0, "verified").when(k % 3 == 1, "quarantined").otherwise(""), "doi": F.concat(F.lit("10.1234/"), k.cast("string")), "authors": F.array(F.lit("Doe, Jane")), "year": F.when(k % 2 == 0, "").otherwise("2001")}
    w = _full_works(spark, sf_dir).withColumns(own).drop("screen").join(labels, "work_id", "left").fillna("", ["screen"])
    gold = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), F.concat(F.lit("https://doi.org/10.1234/"), F.col("item_id").cast("string")).alias("doi"))
    row = metrics.measured(w, gold, QUERY_TERMS, REQUIRED, FORBIDDEN, least=1.0)
    names = [n for n in row if n not in ("dedup_merges", "triage_saving_pct", "triage_yield_pct", "gold_recall_pct")]
    return spark.createDataFrame([tuple(row[n] for n in names)], ", ".join(f"{n} long" for n in names))


@query("""SELECT s_nationkey AS nation, 's' || s_suppkey AS key, CASE WHEN s_suppkey % 2 = 0 THEN 'Ostergaard' ELSE s_name END AS author, 'tides of ' || s_suppkey AS title, CAST(3 * (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) + 1 AS INT) AS line, CASE WHEN s_suppkey % 2 = 0 THEN 'Ostergaard' ELSE regexp_replace(s_name, '[^A-Za-z]', '', 'g') END AS surname FROM supplier""")
def bibtex_in_sql(spark, sf_dir):
    """The suppliers' entries as one BibTeX text a nation, taken apart by the table function in a SQL query."""
    sql.register(spark)
    s, n = table(spark, sf_dir, "supplier"), F.col("s_suppkey").cast("string")
    name = F.when(F.col("s_suppkey") % 2 == 0, r"{\O}sterg{\aa}rd, A.").otherwise(F.concat(F.col("s_name"), F.lit(", B.")))
    entry = F.concat(F.lit("@misc{s"), n, F.lit(", author = {"), name, F.lit("},\n  Title = {Tides of {"), n, F.lit("}}}\n\n"))
    files = s.groupBy("s_nationkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", entry.alias("e")))), lambda x: x["e"]), "").alias("source"))
    return spark.sql(
        """SELECT s_nationkey AS nation, b.key, CASE WHEN fold_latex(b.fields['author']) LIKE 'Osterg%' THEN 'Ostergaard' ELSE substring_index(b.fields['author'], ',', 1) END AS author, title_key(b.fields['title']) AS title, b.line,
        replace(first_surname(b.fields['author']), 'Ostergard', 'Ostergaard') AS surname FROM {files}, LATERAL parse_bibtex(source) AS b WHERE b.kind = 'entry'""",
        files=files,
    )


@query(None)
def bib_render(spark, sf_dir):
    w = _full_works(spark, sf_dir).withColumn("authors", F.array("venue")).withColumn("year", F.lit("2001"))
    return bib.rendered(bib.keyed(bib.normalized(bib.from_works(bib.citable(w))))).select("work_id", "new_key", "bibtex")


_SQL_SEEDS = "ORDER BY (k % 97 = 0) DESC, CASE WHEN k % 97 <> 0 THEN c END DESC NULLS LAST, k LIMIT 10"


@query(f"""WITH e AS MATERIALIZED (SELECT DISTINCT * FROM ({SQL_EDGES})), p AS (SELECT p_partkey AS k, floor(p_retailprice) AS c FROM part),
    c0 AS MATERIALIZED (SELECT k, c FROM p WHERE k % 5 = 0), s1 AS MATERIALIZED (SELECT k FROM c0 WHERE k % 97 = 0 OR k % 3 = 0 {_SQL_SEEDS}),
    r1 AS MATERIALIZED (SELECT cited AS k FROM e WHERE citer IN (SELECT k FROM s1) UNION SELECT citer FROM e WHERE cited IN (SELECT k FROM s1)),
    c1 AS MATERIALIZED (SELECT k, c, 0 AS round FROM c0 UNION ALL SELECT k, c, 1 FROM p WHERE k % 5 <> 0 AND k IN (SELECT k FROM r1)),
    s2 AS MATERIALIZED (SELECT k FROM c1 WHERE (k % 97 = 0 OR k % 3 = 0) AND k NOT IN (SELECT k FROM s1) {_SQL_SEEDS}),
    r2 AS MATERIALIZED (SELECT cited AS k FROM e WHERE citer IN (SELECT k FROM s2) UNION SELECT citer FROM e WHERE cited IN (SELECT k FROM s2))
    SELECT k AS work_id, CAST(round AS INT) AS found_in_round FROM c1 UNION ALL SELECT k, 2 FROM p WHERE k NOT IN (SELECT k FROM c1) AND k IN (SELECT k FROM r2)""")
def snowball_rounds(spark, sf_dir):
    w = parts(spark, sf_dir).withColumn("found_in_round", F.when(F.col("work_id") % 5 == 0, F.lit(0)))
    grown, _ = graph.snowball(w, edges(spark, sf_dir), rounds=2, n_seeds=10, saturation=0.0)
    return grown.where("found_in_round is not null").select("work_id", "found_in_round")


def _verdict_drops(spark, sf_dir):
    """The turns of conversations as verdict lines, in three drops by turn; each drop is taken by a run of its own."""
    c = table(spark, sf_dir, "conversations").where("conv_id is not null")
    verdict = F.when(F.col("turn") % 5 == 4, "maybe").when(F.col("turn") % 2 == 0, "include").when(F.col("turn") % 7 == 3, "unsure").otherwise("exclude")
    line = F.to_json(F.struct(F.col("conv_id").alias("index"), F.col("role").alias("t"), verdict.alias("verdict"), F.col("turn").cast("string").alias("reason"), F.when(F.col("turn") % 4 == 0, "review").otherwise("no such role").alias("role")))
    root = new_path(spark, "drops")
    for drop in range(3):
        own = c.where(F.col("turn") % 3 == drop).select("conv_id", "turn", line.alias("value"))
        own.repartition("conv_id").sortWithinPartitions("conv_id", "turn").select("value").write.mode("append").text(f"{root}/in")
        verdicts.fold(spark, f"{root}/in", f"{root}/changes", f"{root}/state")
    return root


_SQL_LINES = """SELECT *, turn % 3 AS drop, CASE WHEN turn % 2 = 0 THEN 'include' WHEN turn % 7 = 3 THEN 'unsure' ELSE 'exclude' END AS verdict, CASE WHEN turn % 4 = 0 THEN 'review' ELSE '' END AS kind FROM conversations WHERE conv_id IS NOT NULL AND turn % 5 <> 4"""


@query(f"SELECT conv_id AS index, coalesce(role, '') AS t, verdict, CAST(turn AS VARCHAR) AS reason, kind AS role FROM ({_SQL_LINES}) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY drop DESC, turn DESC) = 1")
def latest_verdict(spark, sf_dir):
    return verdicts.latest(spark, f"{_verdict_drops(spark, sf_dir)}/state")


@query(f"""WITH l AS (SELECT * FROM ({_SQL_LINES}) QUALIFY row_number() OVER (PARTITION BY conv_id, drop ORDER BY turn DESC) = 1)
    SELECT conv_id AS index, CAST(drop AS INT) AS drop, verdict, coalesce(lag(verdict) OVER (PARTITION BY conv_id ORDER BY drop), '') AS before FROM l""")
def verdicts_stream(spark, sf_dir):
    return verdicts.changed(spark, f"{_verdict_drops(spark, sf_dir)}/changes").select("index", "drop", "verdict", "before")


def _searched_entries(spark, sf_dir):
    """One entry a part with a title of its own, some fields absent by key."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    doi = F.concat(F.when(k % 6 == 0, "10.9999/").otherwise("10.1234/"), k.cast("string"))
    fields = [("author", F.lit("Smith, J"), k % 7 != 0), ("title", _own_title(k), k % 5 != 0), ("year", (F.lit(1950) + F.col("p_size")).cast("string"), k % 13 != 0), ("journal", F.lit("Journal"), k % 4 != 0), ("doi", doi, k % 2 == 0)]
    array = F.array_compact(F.array(*[F.when(put, F.struct(F.lit(n).alias("name"), v.alias("text"), F.lit("brace").alias("delim"))) for n, v, put in fields]))
    return p.select(F.lit("parts").alias("file"), k.cast("int").alias("node_pos"), F.lit("article").alias("type"), F.lit("article").alias("type_raw"), F.concat(F.lit("k"), k.cast("string")).alias("key"), F.lit(1).alias("line"), array.alias("fields"))


def _own_title(k: Column) -> Column:
    h = F.sha2(k.cast("string"), 256)
    return F.concat_ws(" ", *[F.substring(h, at, 6) for at in (1, 7, 13, 19)])


def _checked_entries(spark, sf_dir):
    """The entries against Crossref records of every fourth part and OpenAlex records of most others, found by DOI or by title search.

    Some records have a longer title, another author or another year.
    """
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    n, crossref = k.cast("string"), k % 4 == 0
    title = F.concat(_own_title(k), F.when(crossref & (k % 3 == 1), " x").otherwise(""))
    year = (F.lit(1950) + F.col("p_size") + F.when(k % 8 == 0, 5).otherwise(0)).cast("string")
    records = p.where(crossref | (k % 10 != 7)).select(
        F.when(crossref, "crossref").otherwise("openalex").alias("source"), F.concat(F.when(crossref, "10.1234/").otherwise("10.7777/"), n).alias("doi"), title.alias("title"),
        F.array(F.when(k % 9 == 0, "Roe, A").otherwise("Smith, J")).alias("authors"), year.alias("year"), F.lit("Journal").alias("journal"), n.alias("volume"), F.lit("").alias("pages"), F.lit("").alias("url"),
    )
    entries = _searched_entries(spark, sf_dir)
    return verification.verified(entries, records, search.hits(entries, records))


_SQL_CHECKED = """SELECT *, r IS NOT NULL AND ((r = 'doi' AND k % 9 = 0 AND k % 7 <> 0) OR (k % 8 = 0 AND k % 13 <> 0) OR (r = 'hit' AND k % 2 = 0)) AS wrong FROM (
    SELECT 'k' || p_partkey AS key, p_partkey AS k, p_size, CASE WHEN p_partkey % 4 = 0 AND p_partkey % 6 <> 0 THEN 'doi'
        WHEN p_partkey % 5 <> 0 AND (p_partkey % 4 = 0 OR p_partkey % 10 <> 7) AND (p_partkey % 7 = 0 OR p_partkey % 9 <> 0) THEN 'hit' END AS r FROM part)"""


@query(f"SELECT key, CASE WHEN r IS NULL THEN 'not_found' WHEN wrong THEN 'mismatched' ELSE 'verified' END AS verdict, CASE WHEN r IS NULL THEN '' WHEN k % 4 = 0 THEN 'crossref' ELSE 'openalex' END AS source FROM ({_SQL_CHECKED})")
def entry_verification(spark, sf_dir):
    return _checked_entries(spark, sf_dir).select("key", "verdict", F.coalesce("record.source", F.lit("")).alias("source"))


@query(f"""WITH c AS ({_SQL_CHECKED}) SELECT key, 'doi-unresolved' AS code, 'error' AS level FROM c WHERE k % 2 = 0 AND r IS DISTINCT FROM 'doi' UNION ALL SELECT key, 'not-found', 'warning' FROM c WHERE r IS NULL
    UNION ALL SELECT key, 'field-mismatch', 'error' FROM c WHERE r = 'doi' AND k % 9 = 0 AND k % 7 <> 0 UNION ALL SELECT key, 'field-mismatch', 'error' FROM c WHERE r = 'hit' AND k % 2 = 0 UNION ALL SELECT key, 'field-mismatch', 'warning' FROM c WHERE r IS NOT NULL AND k % 8 = 0 AND k % 13 <> 0""")
def verification_findings(spark, sf_dir):
    return verification.verification_findings(_checked_entries(spark, sf_dir)).select("key", "code", "level")


@query(f"""SELECT key, CAST(k AS VARCHAR) AS volume, 'Journal' AS journal, CASE WHEN k % 2 = 0 THEN CASE WHEN k % 6 = 0 THEN '10.9999/' ELSE '10.1234/' END ELSE '10.7777/' END || k AS doi,
    CAST(1950 + p_size + CASE WHEN k % 13 = 0 AND k % 8 = 0 THEN 5 ELSE 0 END AS VARCHAR) AS year, len(list_filter([true, k % 4 = 0, k % 2 <> 0, k % 13 = 0], lambda x: x)) AS filled FROM ({_SQL_CHECKED}) WHERE r IS NOT NULL""")
def suggestions_applied(spark, sf_dir):
    done = verification.applied(_checked_entries(spark, sf_dir)).where("record is not null")
    return done.select("key", *[bib.field(n).alias(n) for n in ("volume", "journal", "doi", "year")], F.size(F.filter("found", lambda f: f["code"] == "fixed-from-index")).cast("long").alias("filled"))


@query(f"""SELECT key, unnest(['title', 'author', 'year', 'journal', 'volume', 'doi']) AS field, unnest([CASE WHEN k % 5 = 0 THEN 'missing-local' ELSE 'match' END, CASE WHEN k % 7 = 0 THEN 'missing-local' WHEN k % 9 = 0 THEN 'mismatch' ELSE 'match' END,
    CASE WHEN k % 13 = 0 THEN 'missing-local' WHEN k % 8 = 0 THEN 'mismatch' ELSE 'match' END, CASE WHEN k % 4 = 0 THEN 'missing-local' ELSE 'match' END, 'missing-local', CASE WHEN r = 'doi' THEN 'match' WHEN k % 2 = 0 THEN 'mismatch' ELSE 'missing-local' END]) AS status
    FROM ({_SQL_CHECKED}) WHERE r IS NOT NULL""")
def field_compare(spark, sf_dir):
    return _checked_entries(spark, sf_dir).select("key", F.explode("comparisons").alias("c")).select("key", "c.field", "c.status")


@query(f"""SELECT file, CAST(errors AS BIGINT) AS errors, CASE WHEN errors > 0 THEN 2 ELSE 0 END AS exit_code FROM (
    SELECT CAST(o_orderkey AS VARCHAR) AS file, count(*) FILTER (l_returnflag = 'R') AS errors FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)""")
def exit_codes(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("file"), F.when(F.col("l_returnflag") == "R", "error").otherwise("info").alias("level"))
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("file"))
    return reports.exit_codes(found, files).select("file", "errors", "exit_code")


@query(f"{_SQL_GATE} SELECT g.k AS place, '| ' || substr(t, 1, 70) || ' | ' || CASE g.k % 3 WHEN 0 THEN '10.1234/' || g.k WHEN 1 THEN '10.5281/' || g.k ELSE '-' END || ' | - | ' || CASE WHEN src <> '' THEN 'title disagrees with ' || src WHEN g.k % 3 = 2 THEN 'no DOI, no arXiv id, and no index match on title' ELSE 'DOI ' || CASE g.k % 3 WHEN 0 THEN '10.1234/' ELSE '10.5281/' END || g.k || ' not found in Crossref or DataCite' END || ' |' AS line FROM g JOIN w ON w.k = g.k WHERE NOT ok")
def quarantine_report(spark, sf_dir):
    return reports.quarantine_rows(_gated(spark, sf_dir)).select("place", "line")


@query(f"""SELECT CAST(row_number() OVER (ORDER BY rate DESC, in_corpus DESC, cited_by_count DESC, position) AS INT) AS place, '| ' || CAST(rate AS VARCHAR) || ' | ' || cited_by_count || ' | ' || in_corpus || ' | ' || year || ' | ' || CASE role WHEN '' THEN '-' ELSE role END || ' | t' || work_id || ' | v |  | - |' AS line
    FROM ({SQL_SIGNALS}) QUALIFY place <= 50""")
def shortlist_report(spark, sf_dir):
    w = ranked(spark, sf_dir).withColumns({"title": F.concat(F.lit("t"), F.col("work_id").cast("string")), "venue": F.lit("v"), "oa_pdf_url": F.lit(""), "validation_source": F.lit("")})
    return reports.shortlist_rows(w, 50).select("place", "line")


@query("""SELECT CAST(s_nationkey AS VARCHAR) AS file, n AS number, '[' || n || '] ' || s_name || '. ' || 'T' || s_suppkey || '. J ' || s_nationkey || ', 1-9 (2001). https://doi.org/10.1/' || s_suppkey AS line
    FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier)""")
def plain_bibliography(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    f = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("text"), F.lit("brace").alias("delim"))
    n = F.col("s_suppkey").cast("string")
    fields = F.array(f("author", F.col("s_name")), f("title", F.concat(F.lit("T"), n)), f("journal", F.lit("J")), f("volume", F.col("s_nationkey").cast("string")), f("pages", F.lit("1--9")), f("year", F.lit("2001")), f("doi", F.concat(F.lit("10.1/"), n)))
    e = s.select(F.col("s_nationkey").cast("string").alias("file"), F.col("s_suppkey").cast("int").alias("node_pos"), F.lpad(n, 12, "0").alias("key"), fields.alias("fields"))
    return reports.plain_references(e).select("file", F.col("number").cast("long").alias("number"), "line")


def _field(name: str, value: Column | str) -> Column:
    return F.struct(F.lit(name).alias("name"), (F.lit(value) if isinstance(value, str) else value.cast("string")).alias("text"), F.lit("brace").alias("delim"))


_SQL_OWN = "substr(h, 1, 6) || ' ' || substr(h, 7, 6) || ' ' || substr(h, 13, 6) || ' ' || substr(h, 19, 6)"


@query("""SELECT 'semanticscholar' AS source, CAST(p_partkey AS VARCHAR) AS id, p_name AS title, CAST(1950 + p_size AS VARCHAR) AS year, CASE WHEN p_partkey % 2 = 0 THEN '10.5/x' || p_partkey END AS doi, CASE WHEN p_partkey % 3 = 0 THEN '1905.' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 5, '0') END AS arxiv_id,
    2 AS n_authors, p_brand AS venue, p_size AS cited, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 2 END AS n_references FROM part
    UNION ALL SELECT 'inspire', CAST(p_partkey AS VARCHAR), p_name, CASE WHEN p_partkey % 3 = 0 THEN '2005' ELSE CAST(1950 + p_size AS VARCHAR) END, CASE WHEN p_partkey % 2 = 0 THEN '10.5/x' || p_partkey END, NULL, least(50, p_partkey % 60), CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END, p_size, 0 FROM part""")
def payload_works(spark, sf_dir):
    """Answers of two indexes, written as JSON from the parts and mapped to works."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    n, year, doi = k.cast("string"), (F.lit(1950) + F.col("p_size")).cast("int"), F.when(k % 2 == 0, F.concat(F.lit("10.5/X"), k.cast("string")))
    arxiv = F.when(k % 3 == 0, F.concat(F.lit("1905."), F.lpad((k % 10000).cast("string"), 5, "0"), F.lit("v3")))
    refs = F.when(k % 5 != 0, F.array(F.struct(F.lit("a").alias("paperId")), F.struct(F.lit(None).cast("string").alias("paperId")), F.struct(n.alias("paperId"))))
    scholar = F.struct(n.alias("paperId"), F.col("p_name").alias("title"), year.alias("year"), F.array(*[F.struct(F.lit(a).alias("name")) for a in ("A B", "", "C D")]).alias("authors"), F.struct(doi.alias("DOI"), arxiv.alias("ArXiv")).alias("externalIds"), F.col("p_brand").alias("venue"), F.col("p_size").cast("int").alias("citationCount"), refs.alias("references"))
    people = F.transform(F.filter(F.sequence(F.lit(0), F.lit(59)), lambda i: i < k % 60), lambda i: F.struct(F.concat(F.lit("N"), i.cast("string")).alias("full_name")))
    info = F.when(k % 3 != 0, F.array(F.struct(year.alias("year"), F.col("p_brand").alias("journal_title"))))
    inspire = F.struct(F.struct(n.alias("control_number"), F.array(F.struct(F.col("p_name").alias("title"))).alias("titles"), people.alias("authors"), F.when(k % 2 == 0, F.array(F.struct(doi.alias("value")))).alias("dois"), info.alias("publication_info"), F.lit("2005-03").alias("earliest_date"), F.col("p_size").cast("int").alias("citation_count")).alias("metadata"))
    works_ = payloads.from_semantic_scholar(p.select(F.to_json(scholar).alias("payload"))).unionByName(payloads.from_inspire(p.select(F.to_json(inspire).alias("payload"))))
    source = F.element_at("sources", 1)
    return works_.select(source.alias("source"), F.element_at("source_ids", source).alias("id"), "title", "year", "doi", "arxiv_id", F.size("authors").alias("n_authors"), "venue", F.col("cited_by_count").alias("cited"), F.size("references").alias("n_references"))


@query("""SELECT 'crossref' AS source, '10.5/X' || p_partkey AS doi, 'On ' || p_name || ' waves' AS title, 'Quill, Ada; The Team' AS authors, CAST(1950 + p_size AS VARCHAR) AS year, p_brand AS journal, CAST(p_size AS VARCHAR) AS volume, '1-9' AS pages, NULL AS published_doi, NULL AS published_journal FROM part
    UNION ALL SELECT 'datacite', '10.5281/' || p_partkey, p_name, 'Reed, Bo; Lab', CAST(1950 + p_size AS VARCHAR), CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'Store' END, CAST(p_size AS VARCHAR), '7', NULL, NULL FROM part
    UNION ALL SELECT 'arxiv', NULL, p_name || ' and more', 'Quill, Ada B.; Plato', CAST(1950 + p_size AS VARCHAR), NULL, NULL, NULL, CASE WHEN p_partkey % 2 = 0 THEN '10.5/p' || p_partkey END, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END FROM part""")
def payload_records(spark, sf_dir):
    """Answers for single works of three indexes, written as JSON and Atom from the parts and mapped to records."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    n, year, size = k.cast("string"), (F.lit(1950) + F.col("p_size")).cast("int"), F.col("p_size").cast("string")
    crossref = F.struct(F.concat(F.lit("10.5/X"), n).alias("DOI"), F.array(F.concat(F.lit("On <i>"), "p_name", F.lit("</i>\n waves"))).alias("title"), F.array(F.struct(F.lit("Quill").alias("family"), F.lit("Ada").alias("given"), F.lit(None).cast("string").alias("name")), F.struct(F.lit(None).cast("string").alias("family"), F.lit(None).cast("string").alias("given"), F.lit("The Team").alias("name"))).alias("author"), F.array("p_brand").alias("container-title"), size.alias("volume"), F.lit("1-9").alias("page"), F.struct(F.array(F.array(year, F.lit(3))).alias("date-parts")).alias("issued"))
    datacite = F.struct(F.concat(F.lit("10.5281/"), n).alias("doi"), F.array(F.struct(F.col("p_name").alias("title"))).alias("titles"), F.array(F.struct(F.lit("Bo Reed").alias("name"), F.lit("Reed").alias("familyName"), F.lit("Bo").alias("givenName")), F.struct(F.lit("Lab").alias("name"), F.lit("").alias("familyName"), F.lit(None).cast("string").alias("givenName"))).alias("creators"), year.cast("string").alias("publicationYear"), F.lit("Store").alias("publisher"), F.when(k % 2 == 0, F.struct(F.col("p_brand").alias("title"))).alias("container"), size.alias("volume"), F.lit("7").alias("firstPage"))
    published = F.when(k % 2 == 0, F.concat(F.lit("<a:doi>10.5/p"), n, F.lit("</a:doi><a:journal_ref>"), "p_brand", F.lit("</a:journal_ref>"))).otherwise("")
    atom = F.concat(F.lit('<entry xmlns="http://www.w3.org/2005/Atom" xmlns:a="http://arxiv.org/schemas/atom"><id>http://arxiv.org/abs/'), n, F.lit("v1</id><title>"), "p_name", F.lit("\n  and more</title><author><name>Ada B. Quill</name></author><author><name>Plato</name></author><published>"), year.cast("string"), F.lit("-01-02T00:00:00Z</published>"), published, F.lit("</entry>"))
    # Atom has names given first; a single name stays as it is
    parts = [payloads.record_from_crossref(p.select(F.to_json(crossref).alias("payload"))), payloads.record_from_datacite(p.select(F.to_json(datacite).alias("payload"))), payloads.record_from_arxiv(p.select(atom.alias("payload")))]
    columns = ("source", "doi", "title", "authors", "year", "journal", "volume", "pages", "published_doi", "published_journal")
    out = None
    for part in parts:
        part = part.select(*[F.col(c) if c in part.columns else F.lit(None).cast("string").alias(c) for c in columns]).withColumn("authors", F.array_join(F.transform("authors", lambda a: F.regexp_replace(a, r"^,\s*|,\s*$", "")), "; "))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH s AS (SELECT s_suppkey AS k, sha256(CAST(s_suppkey AS VARCHAR)) AS h FROM supplier) SELECT k AS work_id, CASE WHEN k % 4 = 0 AND k % 3 = 0 THEN 'arxiv' WHEN k % 4 <> 0 AND k % 5 <> 0 THEN 'openalex' ELSE CASE WHEN k % 4 = 0 AND k % 3 = 1 THEN 'arxiv' ELSE '' END END AS validation_source,
    CASE WHEN k % 4 = 0 THEN CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'title disagrees with arxiv' ELSE 'arXiv id 1905.' || lpad(CAST(k % 100000 AS VARCHAR), 5, '0') || ' does not resolve' END WHEN k % 5 <> 0 THEN '' ELSE 'no DOI, no arXiv id, and no index match on title' END AS gate_reason FROM s""")
def gate_tiers(spark, sf_dir):
    """Works with an arXiv id, or with a title only, against records whose titles differ by a word, or altogether."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    arxiv = F.concat(F.lit("1905."), F.lpad((k % 100000).cast("string"), 5, "0"))
    blank = {c: F.lit("") for c in ("year", "venue", "volume", "pages")}
    w = s.select(k.alias("work_id"), k.alias("position"), _own_title(k).alias("title"), F.lit(None).cast("string").alias("doi"), F.when(k % 4 == 0, arxiv).alias("arxiv_id"), F.array().cast("array<string>").alias("authors")).withColumns(blank)
    other, near = F.concat(F.lit("wholly "), F.reverse(_own_title(k))), F.concat(_own_title(k), F.lit(" b"))
    held = s.where(((k % 4 == 0) & (k % 3 != 2)) | ((k % 4 != 0) & (k % 5 != 0)))
    records = held.select(F.when(k % 4 == 0, "arxiv").otherwise("openalex").alias("source"), F.lit("").alias("doi"), F.when((k % 4 == 0) & (k % 3 == 1), other).otherwise(near).alias("title"), F.array(F.lit("Doe, J")).alias("authors"), F.lit("2019").alias("year"), F.lit("").alias("journal"), F.lit("").alias("volume"), F.lit("").alias("pages"), F.when(k % 4 == 0, F.concat(F.lit("http://arxiv.org/abs/"), arxiv, F.lit("v2"))).otherwise("").alias("url"))
    return gate.gate(w, records).select("work_id", "validation_source", "gate_reason")


@query("""WITH s AS (SELECT s_suppkey AS k, 'k' || s_suppkey AS key FROM supplier) SELECT key, 'entry-type-case' AS code, 'info' AS level FROM s WHERE k % 2 = 0 UNION ALL SELECT key, 'unknown-type', 'warning' FROM s WHERE k % 7 = 0 UNION ALL SELECT key, 'preprint', 'warning' FROM s WHERE k % 3 = 0 AND k % 7 <> 0
    UNION ALL SELECT key, 'truncated-authors', 'warning' FROM s WHERE k % 5 = 0 AND k % 7 <> 0 UNION ALL SELECT key, 'unbraced-organisation', 'warning' FROM s WHERE k % 5 = 1 AND k % 7 <> 0 UNION ALL SELECT key, 'bad-author', 'error' FROM s WHERE k % 5 = 2 AND k % 7 <> 0
    UNION ALL SELECT key, 'bad-title', 'error' FROM s WHERE k % 4 = 1 AND k % 7 <> 0 UNION ALL SELECT key, 'redundant-url', 'info' FROM s WHERE k % 6 = 5 AND k % 7 <> 0 UNION ALL SELECT key, 'missing-field', 'error' FROM s WHERE k % 11 = 0 AND k % 3 <> 0 AND k % 6 <> 5 AND k % 7 <> 0
    UNION ALL SELECT key, 'unkeyable', 'error' FROM s WHERE k % 5 = 2""")
def lint_rules(spark, sf_dir):
    """Entries with one fault or more by key: types, preprints, authors, titles, links, software without any link, keys."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    author = F.when(k % 5 == 0, "Doe, J. and others").when(k % 5 == 1, "Harbour Systems").when(k % 5 == 2, "{}, {}").otherwise("Doe, J.")
    # software that is no preprint has a DOI with its link, or a link alone; every eleventh has none
    fields = [("author", author, F.lit(True)), ("title", F.when(k % 4 == 1, "{$}").otherwise("Tides"), F.lit(True)), ("year", F.lit("2001"), F.lit(True)), ("eprint", F.lit("1905.00001"), k % 3 == 0), ("doi", F.concat(F.lit("10.1234/x"), k.cast("string")), k % 6 == 5), ("url", F.concat(F.lit("https://doi.org/10.1234/x"), k.cast("string")), (k % 6 == 5) | (k % 11 != 0))]
    kind = F.when(k % 7 == 0, "poster").otherwise("software")
    e = s.select(F.lit("f").alias("file"), k.cast("int").alias("node_pos"), kind.alias("type"), F.when(k % 2 == 0, F.initcap(kind)).otherwise(kind).alias("type_raw"), F.concat(F.lit("k"), k.cast("string")).alias("key"), F.lit(1).alias("line"), F.array_compact(F.array(*[F.when(put, _field(n, v)) for n, v, put in fields])).alias("fields"))
    found = bib.findings(bib.keyed(e)).where("code not in ('missing-recommended')")
    old = bib.keyed(e).select(F.col("key").alias("old"), "new_key")
    return found.join(old, found["key"] == old["new_key"]).select(F.col("old").alias("key"), "code", "level")


@query("""SELECT s_suppkey AS file, CASE s_suppkey % 4 WHEN 0 THEN 'unbalanced ''{'' on line 2' WHEN 1 THEN 'expected an entry type after @ on line 3' WHEN 2 THEN 'duplicate field ''title'' in entry ''k' || s_suppkey || ''' on line 2' END AS error, CASE WHEN s_suppkey % 4 = 3 THEN s_name END AS title FROM supplier""")
def broken_files(spark, sf_dir):
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    n = k.cast("string")
    source = F.when(k % 4 == 0, F.concat(F.lit("% x\n@misc{k"), n, F.lit(", title = {a"))).when(k % 4 == 1, F.lit("\n\n@ misc{a}")).when(k % 4 == 2, F.concat(F.lit("\n@misc{k"), n, F.lit(", title = {a}, title = {b}}"))).otherwise(F.concat(F.lit('@misc{k, title = "'), "s_name", F.lit('"}')))
    nodes = bib.parse_files(s.select(n.alias("file"), source.alias("source")), strict=False)
    return nodes.select(F.col("file").cast("long").alias("file"), "error", F.when(F.col("kind") == "entry", bib.field("title")).alias("title"))


@query(f"""SELECT batch, count(*) AS n, min(doc_id) AS first_index, arg_min(title, doc_id) AS first_title, arg_min(c, doc_id) AS first_check, arg_min(a, doc_id) AS first_abstract FROM (
    SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 25 AS batch, doc_id, {SQL_TITLE} AS title, array_to_string(list_slice(string_split({SQL_TITLE}, ' '), 1, 4), ' ') AS c, nullif(substr(trim(text), 1, 600), '') AS a FROM documents) GROUP BY batch""")
def screen_payloads(spark, sf_dir):
    """The JSON objects that a screener gets, one a batch, taken apart again."""
    files = screening.batch_files(screening.batches(works(spark, sf_dir).withColumn("year", F.lit(""))))
    first = lambda c: F.get_json_object("payload", f"$.works[0].{c}")
    n = F.size(F.from_json(F.get_json_object("payload", "$.works"), "array<struct<i:long>>")).cast("long")
    return files.select("batch", n.alias("n"), first("i").cast("long").alias("first_index"), first("t").alias("first_title"), first("c").alias("first_check"), first("a").alias("first_abstract"))


@query("""SELECT o_orderkey AS index, CASE WHEN o_orderkey % 3 = 0 THEN 'unsure' ELSE 'include' END AS verdict, o_orderstatus AS t, CASE WHEN o_orderkey % 2 = 0 THEN 'method' ELSE '' END AS role FROM orders WHERE o_orderkey % 5 <> 0""")
def verdict_file(spark, sf_dir):
    """Verdict lines of the orders, broken lines among them; the last line of an index counts."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    line = lambda v: F.to_json(F.struct(k.cast("string").alias("index"), F.col("o_orderstatus").alias("t"), v.alias("verdict"), F.when(k % 2 == 0, "method").otherwise("poet").alias("role")))
    lines = F.when(k % 5 == 0, F.concat(F.lit("{broken "), k.cast("string"))).when(k % 3 == 0, F.concat_ws("\n", line(F.lit("exclude")), line(F.lit("unsure")))).otherwise(F.concat_ws("\n", line(F.lit("include")), line(F.lit("perhaps"))))
    path = new_path(spark, "verdicts")
    o.select(lines.alias("value")).write.text(path)
    return readers.read_verdicts(spark, path).select("index", "verdict", "t", "role")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS cite_key, CAST(l_quantity AS VARCHAR) AS quantity, l_returnflag AS source_quote, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_linenumber <> 2 GROUP BY ALL")
def evidence_file(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    row = F.to_json(F.struct(F.col("l_orderkey").alias("cite_key"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("source_quote"), F.lit(1).alias("unknown")))
    path = new_path(spark, "evidence")
    li.select(F.when(F.col("l_linenumber") == 2, F.concat(F.lit("["), row)).otherwise(row).alias("value")).write.text(path)
    back = readers.read_evidence(spark, path, ["quantity"])
    return back.groupBy("cite_key", "quantity", "source_quote").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS k, 's' || s_suppkey AS key, 'https://doi.org/10.5/' || s_suppkey AS doi, CAST(1900 + s_nationkey AS INT) AS year FROM supplier")
def gold_file(spark, sf_dir):
    """Gold sets of the suppliers, one file a nation: objects with papers, or bare lists."""
    s, n = table(spark, sf_dir, "supplier"), F.col("s_suppkey").cast("string")
    paper = F.struct(F.concat(F.lit("s"), n).alias("key"), F.concat(F.lit("https://doi.org/10.5/"), n).alias("doi"), (F.lit(1900) + F.col("s_nationkey")).cast("int").alias("year"), F.lit("x").alias("coupler"))
    papers = s.groupBy("s_nationkey").agg(F.to_json(F.collect_list(paper)).alias("p"))
    path = new_path(spark, "gold")
    whole = F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit('{"papers": '), "p", F.lit("}"))).otherwise(F.col("p"))
    papers.select("s_nationkey", whole.alias("value")).repartition("s_nationkey").write.partitionBy("s_nationkey").text(path)
    return readers.read_gold(spark, path).select(F.substring("key", 2, 20).cast("long").alias("k"), "key", "doi", "year")


@query(f"SELECT min(doc_id) AS first, count(*) AS n, max(length({SQL_TITLE})) AS cited_by_count FROM documents WHERE {SQL_TITLE} <> '' GROUP BY {SQL_TITLE}")
def corpus_file(spark, sf_dir):
    """The documents as a corpus file, equal titles with one DOI, written in order and read back through the merge."""
    w = _full_works(spark, sf_dir).where("title <> ''")
    w = w.withColumns({"doi": F.concat(F.lit("10.5/"), F.sha2(F.col("title").cast("binary"), 256)), "sources": F.array(F.col("work_id").cast("string")), "abstract": F.lit(""), "title": F.regexp_replace("title", "[a-z0-9]", "?")})
    path = new_path(spark, "corpus")
    readers.write_works(w, path)
    # titles are blotted out, so that only the DOI links works
    back = readers.read_corpus(spark, path)
    return back.select(F.element_at("sources", 1).cast("long").alias("first"), F.size("sources").cast("long").alias("n"), F.col("cited_by_count").cast("long").alias("cited_by_count"))


@query("""SELECT s_suppkey, 3 AS n_authors, 'Ostergard' AS second, regexp_replace(s_name, '[^A-Za-z]', '', 'g') AS representative, '{\\''e}' || s_name || '--' AS spelled, CASE WHEN s_suppkey % 2 = 0 THEN 'hep-th/990' || lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0') ELSE '1905.' || lpad(CAST(s_suppkey % 100000 AS VARCHAR), 5, '0') END AS arxiv,
    s_name || ' --- "a" ...' AS plain, s_suppkey % 2 = 0 AS pages, true AS journal, CASE WHEN s_suppkey % 2 = 0 THEN 'https://arxiv.org/pdf/' || s_suppkey ELSE '' END AS pdf FROM supplier""")
def name_functions(spark, sf_dir):
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    n = k.cast("string")
    names = F.concat("s_name", F.lit(", B.\n and {The Group and Co} and Østergård, Å."))
    arxiv = F.when(k % 2 == 0, F.concat(F.lit("see hep-th/990"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("v2, now"))).otherwise(F.concat(F.lit("arXiv:1905."), F.lpad((k % 100000).cast("string"), 5, "0"), F.lit("v1")))
    people = F.array(F.lit("The Harbour Collaboration"), F.concat("s_name", F.lit(", B.")))
    return s.select(
        k, F.size(T.authors_udf(names)).alias("n_authors"), T.surname_udf(F.element_at(T.authors_udf(names), -1)).alias("second"), gate.representative_surname(people).alias("representative"), T.latex_udf(F.concat(F.lit("é"), "s_name", F.lit("–"))).alias("spelled"), T.find_arxiv_id(arxiv).alias("arxiv"),
        T.ascii_punctuation(F.concat(F.lit("{"), "s_name", F.lit("}\n — “a” …"))).alias("plain"), T.same_pages(F.concat(F.lit("1--9"), F.substring(n, 1, 0)), F.when(k % 2 == 0, "1 – 9").otherwise("1-8")).alias("pages"), T.same_journal(F.concat(F.lit("phys rev b"), F.substring(n, 1, 0)), F.lit("physical review b")).alias("journal"), T.arxiv_pdf_url(F.when(k % 2 == 0, n)).alias("pdf"),
    )


@query(f"""WITH x AS ({ORACLE_SQL['snowball_rounds']}) SELECT r AS round, count(*) FILTER (found_in_round = r) AS new, count(*) FILTER (found_in_round <= r) AS corpus, round(count(*) FILTER (found_in_round = r) / count(*) FILTER (found_in_round <= r), 4) AS new_fraction FROM x, (VALUES (1), (2)) v(r) GROUP BY r""")
def snowball_report(spark, sf_dir):
    w = parts(spark, sf_dir).withColumn("found_in_round", F.when(F.col("work_id") % 5 == 0, F.lit(0)))
    _, report = graph.snowball(w, edges(spark, sf_dir), rounds=2, n_seeds=10, saturation=0.0)
    return spark.createDataFrame([(r["round"], r["new"], r["corpus"], r["new_fraction"]) for r in report], "round long, new long, corpus long, new_fraction double")
