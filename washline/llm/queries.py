"""Registered queries of this subpackage, with their expected results where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from washline.llm.rules import apply_rules, rules_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def in_fold(fold: int, of: int):
    """A row without doc_id is in no held-out fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == fold, F.lit(False))


@query
def op6_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose crc32 fold of 3 is not 1."""
    from washline.llm import ppm

    docs = table(spark, sf_dir, "documents")
    trees = ppm.fit(docs.where(~in_fold(1, 3)))
    return ppm.predict(docs, trees).select("doc_id", in_fold(1, 3).alias("held_out"), "lang_pred", "score")


@query
def op7_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 2048 ids."""
    from washline.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), size=2048, end_id=1)


@query
def op10_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels whose crc32 fold of 4 is not 2."""
    from washline.llm import boosting

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    forest = boosting.train(docs, labels.where(~in_fold(2, 4)))
    return boosting.score(docs, forest).select(
        "doc_id", in_fold(2, 4).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query
def op8_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and number of links of every document at a Jaccard coefficient of 0.8 of five-word shingles."""
    from washline.llm.forest import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=5, threshold=0.8)


@query
def op9_count_min_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 50-word windows that an earlier document has."""
    from washline.llm.substrings import remove_repeated

    return remove_repeated(table(spark, sf_dir, "documents"), width=50)


@query
def op2_entropy_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that a mix of 150 percent of all words takes of it."""
    from washline.llm.balance import cycled_targets, mix_sources

    return mix_sources(table(spark, sf_dir, "documents"), cycled_targets((5, 2, 1), share=1.5, most=2), most=2)


@query
def op4_threshold_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    return apply_rules(table(spark, sf_dir, "documents"))


ORACLES["op4_threshold_rules"] = rules_sql()


@query
def op5_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row stays of equal texts, by a stream over the documents."""
    from washline.llm.stream_dedup import exact_duplicates

    return exact_duplicates(spark, f"{sf_dir}/documents.parquet").drop("file", "row")


ORACLES["op5_stream_dedup"] = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS c,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS n
  FROM documents),
k AS (
  SELECT *, row_number() OVER w AS p, first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY n) AS group_size
  FROM d WINDOW w AS (PARTITION BY n ORDER BY c DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, p = 1 AS kept, sha256(n) AS text_sha256 FROM k
"""


@query
def op1_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the perspective of each participant; the mask as character ranges."""
    from washline.llm.perspectives import rotate

    masked = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return rotate(table(spark, sf_dir, "conversations")).withColumn("masked", masked).drop("spans")


ORACLES["op1_perspective_rotation"] = """
WITH m AS (
  SELECT conv_id, coalesce(role, 'unknown') AS s,
         replace(replace(coalesce(text, ''), '<|', '< |'), '|>', '| >') || '<|im_end|>' AS body,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS rank,
         (count(*) OVER (PARTITION BY conv_id) - 1) // 256 AS last
  FROM conversations),
a AS (
  SELECT conv_id, s, body, rank, rank // 256 AS part, FALSE AS context FROM m
  UNION ALL
  SELECT conv_id, s, body, rank, unnest(range(1, last + 1)), TRUE FROM m WHERE s = 'system' AND rank < 256
  UNION ALL
  SELECT conv_id, s, body, rank, rank // 256 + 1, TRUE FROM m
  WHERE rank % 256 >= 224 AND rank // 256 < last AND NOT (s = 'system' AND rank < 256)),
p AS (SELECT DISTINCT conv_id, part, s AS perspective FROM a WHERE s <> 'system' AND NOT context),
v AS (
  SELECT a.conv_id, perspective, a.part, rank, context, s = perspective AND NOT context AS own, body,
         '<|im_start|>' || CASE WHEN s = perspective THEN 'assistant' WHEN s = 'system' THEN 'system'
           ELSE 'user name=' || regexp_replace(s, '[^\\p{L}\\p{N}_.-]+', '_', 'g') END || chr(10) AS head
  FROM a JOIN p ON a.conv_id IS NOT DISTINCT FROM p.conv_id AND a.part = p.part),
o AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (
    PARTITION BY conv_id, perspective, part ORDER BY rank) - length(body) - 1 AS start FROM v)
SELECT conv_id, perspective, CAST(part AS BIGINT) AS part, CAST(count(*) FILTER (NOT context) AS BIGINT) AS n_turns,
       CAST(count(*) FILTER (context) AS BIGINT) AS n_context,
       CAST(count(*) FILTER (own) AS BIGINT) AS n_own, string_agg(head || body || chr(10), '' ORDER BY rank) AS text,
       coalesce(string_agg(CAST(start AS BIGINT) || '-' || CAST(start + length(body) AS BIGINT), ',' ORDER BY rank) FILTER (own), '') AS masked
FROM o GROUP BY conv_id, perspective, part
"""


@query
def op3_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms for its personal numbers, dates and mail addresses."""
    from washline.llm.pseudonyms import pseudonymise

    # A deployment passes its own secret; the tables are synthetic.
    return pseudonymise(table(spark, sf_dir, "documents"), key="synthetic tables")


@query
def op11_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of eight shards of near equal bytes."""
    from washline.llm.kdtree import kd_shards

    return kd_shards(table(spark, sf_dir, "documents"), shards=8).withColumns(
        {"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}
    )


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from every document table, in all orders, step by step."""
    from washline.llm.audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op12_filter_audit"] = """
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN least < w.doc_id OR (w.doc_id IS NULL AND least IS NOT NULL) THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before
  FROM o, unnest([1, 2, 3, 4, 5]) AS u(step)),
c AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN len(list_intersect(string_split(fails, ''), string_split(before || f, ''))) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN hit AND free THEN n ELSE 0 END) AS removed, sum(CASE WHEN hit AND NOT free THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN hit AND free THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND free THEN toxic ELSE 0 END) AS toxic_lost
  FROM (SELECT *, contains(fails, f) AS hit, len(list_intersect(string_split(fails, ''), string_split(before, ''))) = 0 AS free
        FROM (SELECT part, filter_order, step, f, before, fails, n, good, toxic FROM g, s))
  GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM c
"""


@query
def op13_fenwick_middles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut at line ends and reordered for filling in middles, as digests."""
    from washline.llm.middles import fill_in_middle, restored

    back = restored(F.col("output"), F.col("form"))
    digests = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(back, 256)}
    return fill_in_middle(table(spark, sf_dir, "documents")).withColumns(digests).drop("output")


ORACLES["op13_fenwick_middles"] = """
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
c AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a,
         CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
           WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
p AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS prefix, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle,
         array_to_string(u[greatest(a, b) + 1:n], '') AS suffix
  FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
"""


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline over the documents."""
    from corpus_pipeline import run

    return run(spark, sf_dir)
