"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: The vocabulary of op3: a rank file of a public byte vocabulary.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairsight.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents")).drop("verified_runs")


OP1_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id,
       first(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
       CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) = 1 AS kept,
       text_sha256
FROM n
"""

def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairsight.llm.suffix_dedup import without_repeated_bytes

    return without_repeated_bytes(table(spark, sf_dir, "documents"), width=200)


OP7_SQL = r"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(generate_series(0, CAST(length(h) / 2 AS BIGINT) - 1)) AS i FROM t),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS b, CASE WHEN 2 * i + 400 <= length(h) THEN md5(substr(h, 2 * i + 1, 400)) END AS k FROM p),
d AS (SELECT doc_id, i, b, CASE WHEN k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1 THEN 1 ELSE 0 END AS d FROM w),
r AS (SELECT doc_id, i, b, max(d) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS r FROM d),
s AS (SELECT doc_id, i, b, r, CASE WHEN r = 1 AND coalesce(lag(r) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 THEN 1 ELSE 0 END AS first FROM r),
g AS (SELECT doc_id, sum(r) AS n_removed, sum(first) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (WHERE r = 0) AS kept FROM s GROUP BY doc_id)
SELECT t.doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM t LEFT JOIN g USING (doc_id)
"""


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairsight.llm.substring_dedup import without_repeated_words

    return without_repeated_words(table(spark, sf_dir, "documents"), width=13)


OP9_SQL = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM t),
k AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 12 <= len(w) THEN array_to_string(w[i:i + 12], ' ') END AS win FROM p),
d AS (SELECT doc_id, i, word, CASE WHEN win IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY win) THEN 1 ELSE 0 END AS d FROM k),
r AS (SELECT doc_id, i, word, max(d) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS r FROM d),
g AS (SELECT doc_id, sum(r) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE r = 0) AS kept FROM r GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN g USING (doc_id)
"""

def op3_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    from pairsight.llm.token_counts import read_vocabulary, token_counts

    return token_counts(table(spark, sf_dir, "documents"), read_vocabulary(vocabulary))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairsight.llm.secrets import secret_spans

    return secret_spans(table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairsight.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairsight.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairsight.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairsight.llm.ngram_join import similar_components

    return similar_components(table(spark, sf_dir, "documents"), width=3, percent=90)


OP8_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM t),
d AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM g),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
i AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM d a JOIN d b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a)
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.component_id, t.doc_id) AS component_id
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY node) m ON m.node = t.doc_id
"""


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairsight.llm.lm_scoring import code_lengths

    return code_lengths(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_token_counts": op3_token_counts,
    "op4_decontaminate": op4_decontaminate,
    "op5_secret_scan": op5_secret_scan,
    "op6_mix_sources": op6_mix_sources,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_ngram_join": op8_ngram_join,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_toxicity": op10_toxicity,
}
#: By queries that SQL can express; the others are held against brute force in tests/llm.
ORACLES = {"op1_exact_dedup": OP1_SQL, "op7_suffix_dedup": OP7_SQL, "op8_ngram_join": OP8_SQL, "op9_substring_dedup": OP9_SQL}
