"""One query per operator over the test tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from gradewell.llm import (
    chat_trees,
    decontamination,
    language_id,
    license_scan,
    lm_scoring,
    near_dedup,
    packing,
    quality,
    sharding,
    substring_dedup,
    toxicity,
    vector_codes,
    whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where there is one."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def word_tokenizer() -> str:
    """Where the public word tokenizer lies; operators take such a path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents WHERE doc_id IS NOT NULL
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i : i + 3], ' ') FOR i IN range(1, len(w) - 2)]
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words
), shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, b AS c FROM both_ways UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON r.c = l.a),
least_id AS (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(l.c, s.doc_id)) AS component_id,
       s.doc_id = least(s.doc_id, coalesce(l.c, s.doc_id)) AS kept
FROM sets s LEFT JOIN least_id l USING (doc_id)""")
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with a Jaccard similarity of four-word shingles of 0.8 or more."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4, percent=80)


@query()
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence family that each document states."""
    return license_scan.scan_licences(table(spark, sf_dir, "documents"))


@query("""
WITH texts AS (
  SELECT doc_id AS id, true AS is_doc, text FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT item_id, false, text FROM benchmark WHERE item_id IS NOT NULL
), words AS (
  SELECT id, is_doc, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM texts
), shingles AS (
  SELECT DISTINCT id, is_doc, unnest([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, greatest(1, len(w) - 3))]) AS g FROM words
), sizes AS (SELECT id AS item_id, count(*) AS n_item FROM shingles WHERE NOT is_doc GROUP BY id),
shared AS (
  SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared FROM shingles d JOIN shingles b ON d.g = b.g AND d.is_doc AND NOT b.is_doc
  GROUP BY d.id, b.id
)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM shared JOIN sizes USING (item_id)
WHERE n_shared >= ceil(n_item * 0.8 - 1e-9)""")
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item's five-word shingles."""
    return decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(14 + 2 * length(text) - length(regexp_replace(text, '[\\\\#<]', '', 'g'))
                + 2 * length(role) - length(regexp_replace(role, '[\\\\#<:]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id""")
def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as one text, and digests of what is read back from it."""
    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_trees.conversation_digests(rows).drop("formatted")


@query("""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS p,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
runs AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest([w[i : i + 2] FOR i IN range(1, len(w) - 1)]) AS run FROM w WHERE len(w) > 2),
often AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS n FROM runs) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM often, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
classes AS (
  SELECT r, lang, length(text) AS n_chars, len(w) AS n_words,
         [length(text) - length(regexp_replace(text, '\\p{Lu}', '', 'g')), length(text) - length(regexp_replace(text, '\\p{Nd}', '', 'g')),
          length(text) - length(regexp_replace(text, '[.,;:!?''"()-]', '', 'g')), length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')),
          length(text) - length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))] AS c FROM w),
totals AS (SELECT lang, count(*) AS n_docs, sum(n_chars) AS n_chars, sum(n_words) AS n_all,
                  [sum(c[1]), sum(c[2]), sum(c[3]), sum(c[4]), sum(c[5])] AS c FROM classes GROUP BY lang HAVING count(*) >= 20 AND sum(n_words) > 0),
counts AS (SELECT r, lang, word, count(*) AS n FROM (SELECT r, lang, unnest(p) AS word FROM w) GROUP BY ALL),
usual AS (SELECT lang, word, sum(n) / any_value(n_all) AS q FROM counts JOIN totals USING (lang) GROUP BY lang, word HAVING sum(n) * 200 >= any_value(n_all)),
bins AS (
  SELECT c.r, coalesce(n, 0) / n_words AS a, q AS b FROM classes c JOIN usual u USING (lang)
    LEFT JOIN counts k ON k.r = c.r AND k.word = u.word WHERE n_words >= 100
  UNION ALL
  SELECT c.r, 1 - (SELECT coalesce(sum(n), 0) FROM counts k JOIN usual u USING (lang, word) WHERE k.r = c.r) / n_words,
         1 - (SELECT coalesce(sum(q), 0) FROM usual u WHERE u.lang = c.lang) FROM classes c JOIN totals USING (lang) WHERE n_words >= 100),
wd AS (SELECT r, sqrt(greatest(0, sum((CASE WHEN a > 0 THEN a * log2(2 * a / (a + b)) ELSE 0 END + CASE WHEN b > 0 THEN b * log2(2 * b / (a + b)) ELSE 0 END) / 2))) AS x
       FROM bins GROUP BY r),
cbins AS (
  SELECT r, unnest([x / c.n_chars FOR x IN list_append(c.c, c.n_chars - list_sum(c.c))]) AS a,
         unnest([x / t.n_chars FOR x IN list_append(t.c, t.n_chars - list_sum(t.c))]) AS b
  FROM classes c JOIN totals t USING (lang) WHERE c.n_chars >= 200),
cd AS (SELECT r, sqrt(greatest(0, sum((CASE WHEN a > 0 THEN a * log2(2 * a / (a + b)) ELSE 0 END + CASE WHEN b > 0 THEN b * log2(2 * b / (a + b)) ELSE 0 END) / 2))) AS x
       FROM cbins GROUP BY r),
base AS (
  SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(wd.x, 0) <= 0.3 AND coalesce(cd.x, 0) <= 0.3 AS kept
FROM base LEFT JOIN wd USING (r) LEFT JOIN cd USING (r)""")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document, and whether the rules keep it."""
    return quality.quality(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


@query()
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer(), 2048)


@query()
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight contiguous shards of nearly equal bytes."""
    return sharding.shards(table(spark, sf_dir, "documents"), 8)


@query()
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without passages that an earlier document, or place, holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = substring_dedup.drop_repeated(docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0))))
    left = F.coalesce(F.length("text"), F.lit(0))
    return cut.select("doc_id", "text", (F.col("n_chars") - left).cast("long").alias("removed_chars"), (F.col("n_chars") > left).alias("changed"))


@query()
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How toxic every document is, learned from labels outside one fold of three."""
    return toxicity.held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those outside one fold of four."""
    return language_id.held_out_predictions(table(spark, sf_dir, "documents"))


def codes_sql() -> str:
    """Two rounds of assignments and floored means, then the codes, as one statement for each step."""
    nearest = """near{0} AS (
  SELECT vec_id, r, label, p, v, min(struct_pack(d := d, i := i)) AS best FROM (
    SELECT x.*, i, list_sum(list_transform(list_zip(x.v, b.v), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d FROM cut x JOIN book{0} b USING (p))
  GROUP BY vec_id, r, label, p, v)"""
    means = """places{0} AS (SELECT p, best.i AS i, unnest(v) AS c, generate_subscripts(v, 1) AS k FROM near{0}),
floors{0} AS (SELECT p, i, k, sum(c) AS s, count(*) AS n FROM places{0} GROUP BY p, i, k),
means{0} AS (SELECT p, i, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY k) AS v FROM floors{0} GROUP BY p, i),
book{1} AS (SELECT p, i, coalesce(m.v, b.v) AS v FROM book{0} b LEFT JOIN means{0} m USING (p, i))"""
    return """
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, label, [CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), cut AS (SELECT vec_id, r, label, p, x[p * (len(x) // 16) + 1 : (p + 1) * (len(x) // 16)] AS v FROM kept, (SELECT unnest(range(16)) AS p)),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM (SELECT DISTINCT vec_id FROM kept WHERE vec_id IS NOT NULL) ORDER BY vec_id LIMIT 64),
book0 AS (SELECT p, i, v FROM cut JOIN firsts USING (vec_id)),
""" + ",\n".join([nearest.format(0), means.format(0, 1), nearest.format(1), means.format(1, 2), nearest.format(2)]) + """,
codes AS (SELECT vec_id, r, label, string_agg(format('{:02x}', best.i), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near2 GROUP BY vec_id, r, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, i)) FROM book2) AS codebooks_sha256
FROM codes"""


@query(codes_sql())
def op11_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as sixteen codes, with its exact error and that of its label."""
    return vector_codes.code_report(table(spark, sf_dir, "embeddings"))


@query()
def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How probable every document is, learned from those outside one fold of ten."""
    return lm_scoring.held_out_scores(table(spark, sf_dir, "documents"))


@query()
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four leading whitened components of every vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id")


@query()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of the corpus pipeline, one after the other, over all documents."""
    return corpus_pipeline.run(spark, sf_dir)
