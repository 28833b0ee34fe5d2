"""The queries opN_<name> of the training-data operators and the SQL that some of them can be held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def vocabulary(name: str) -> str:
    """The place of a public tokenizer file; a parameter of the operators, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bibloom.llm import packing

    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end=0, length=1024, memory=700_000)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bibloom.llm import line_dedup

    return line_dedup.fuzzy_lines(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bibloom.llm import exact_dedup

    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bibloom.llm import substring_dedup

    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bibloom.llm import language

    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bibloom.llm import html_extraction

    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bibloom.llm import token_counts

    return token_counts.counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bibloom.llm import cross_polytope

    return cross_polytope.link(table(spark, sf_dir, "embeddings"), 0.98)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bibloom.llm import sentencepiece_backend as backend

    docs, model = table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")
    decoded = backend.round_trip(docs, model)
    return decoded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "parity")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bibloom.llm import near_dedup

    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bibloom.llm import whitening

    embeddings = table(spark, sf_dir, "embeddings")
    return whitening.whitened(embeddings, whitening.fit(embeddings, k=4))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bibloom.llm import spelling

    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bibloom.llm import quality

    return quality.assessed(table(spark, sf_dir, "documents")).drop("votes")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_packing, op2_line_dedup, op3_exact_dedup, op4_substring_dedup, op5_language_id, op6_html_extraction, op7_token_counts, op8_embedding_near_dedup, op9_sentencepiece, op10_minhash_near_dedup, op11_embedding_whitening, op12_spelling_variants, op13_quality_rules, pipeline)
}

ORACLE_SQL = {
    "op3_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY x)""",
    "op8_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, x -> x <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
              WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        r(s, x) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.s, l.b FROM r JOIN l ON l.a = r.x)
        SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, e.vec_id = c.c AS kept
        FROM embeddings e JOIN (SELECT s, min(x) AS c FROM r GROUP BY s) c ON c.s = e.vec_id
        LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = e.vec_id""",
    "op12_spelling_variants": """
        WITH RECURSIVE t AS MATERIALIZED (
            SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
        r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS d, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{6,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
        b AS (SELECT run, flatten(list_transform(string_split(d || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, CAST(unicode(x) AS BIGINT) - 64] END)) AS bytes FROM r),
        h AS (SELECT run, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(t.t[CAST(xor(c, x) & 255 AS INT) + 1], c >> 8)), 4294967295) AS h FROM b, t),
        w AS MATERIALIZED (
            SELECT word, count(*) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h)
            WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
        d AS MATERIALIZED (SELECT word, n, length(word) AS l, i, substr(word, 1, i - 1) || substr(word, i + 1) AS x FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
        p AS MATERIALIZED (
            SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.x = b.x AND a.i = b.i AND a.l = b.l AND a.word <> b.word
            UNION SELECT d.word, d.n, w.word, w.n FROM d JOIN w ON d.x = w.word UNION SELECT w.word, w.n, d.word, d.n FROM d JOIN w ON d.x = w.word),
        f AS MATERIALIZED (
            SELECT w.word, w.n, coalesce(c.c, 0) AS n_near, CASE WHEN c.near_n >= 5 * w.n THEN c.near END AS form, CASE WHEN c.near_n >= 5 * w.n THEN c.near_n END AS form_n FROM w
            LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY word) AS c FROM p QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1) c USING (word)),
        q(word, tip) AS (SELECT word, word FROM f UNION ALL SELECT q.word, f.form FROM q JOIN f ON f.word = q.tip WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, q.tip AS root, f.n, f.n_near, f.form_n FROM f JOIN q ON q.word = f.word JOIN f e ON e.word = q.tip AND e.form IS NULL""",
}
