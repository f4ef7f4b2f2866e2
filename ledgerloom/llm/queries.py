"""The queries opN_<name> with production parameters, and their DuckDB statements where SQL can state them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.archives import archive
from ledgerloom.llm.best_fit import pack_best_fit
from ledgerloom.llm.collocations import collocations
from ledgerloom.llm.counted_fit import pack_by_lengths
from ledgerloom.llm.decontaminate import with_hits
from ledgerloom.llm.hard_negatives import hard_negatives
from ledgerloom.llm.html_text import with_main_text
from ledgerloom.llm.jaccard import near_duplicates
from ledgerloom.llm.line_dedup import with_line_bitmaps
from ledgerloom.llm.packing import pack
from ledgerloom.llm.quality import quality_verdicts
from ledgerloom.llm.repeats import without_repeats
from ledgerloom.llm.toxicity import learn, with_score


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = with_line_bitmaps(_table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_verdicts(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_best_fit(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return without_repeats(_table(spark, folder, "documents"), with_bytes=False).drop("kept_bytes")


def op5_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    found = with_main_text(_table(spark, folder, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = with_hits(_table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "benchmark"))
    hit = F.col("contamination")
    return found.select(
        "doc_id", hit["n_words"].alias("n_words"), hit["n_hit"].alias("n_hit"), F.size(hit["item_ids"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(hit["item_ids"], ","), 256).alias("items_sha256"), (hit["n_hit"] > 0).alias("contaminated"),
    )


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    lexicon = learn(docs, _table(spark, folder, "labels").select("doc_id", "toxic"), ~held_out)
    scored = with_score(docs, lexicon).withColumn("held_out", held_out)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents"))


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False).drop("ids")


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    found = archive(_table(spark, folder, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(_table(spark, folder, "documents"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    number, label = F.col("vec_id"), F.col("label")
    flipped = F.when(number % 7 == 0, (label.cast("long") + 1) % 10).otherwise(label)
    vectors = _table(spark, folder, "embeddings").withColumn("label", flipped)
    return hard_negatives(vectors, number % 100 == 0)


def op13_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_by_lengths(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False).drop("ids")


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_html_extraction": op5_html_extraction,
    "op6_decontamination": op6_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_packing": op9_packing,
    "op10_warc": op10_warc,
    "op11_collocations": op11_collocations,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_best_fit_packing": op13_best_fit_packing,
}

SQL = {
    "op1_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), marked AS (
  SELECT doc_id, pos, line, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS dropped FROM keyed
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op6_decontamination": r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS size, array_to_string(words[i : i + 9], ' ') AS win
  FROM (SELECT item_id, words, unnest(range(1, greatest(2, len(words) - 8))) AS i FROM item_words WHERE len(words) > 0)
), sizes AS (SELECT DISTINCT size FROM item_windows
), doc_windows AS (
  SELECT doc_id, i, size, array_to_string(words[i : i + size - 1], ' ') AS win
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM doc_words, sizes WHERE len(words) >= size)
), found AS (SELECT doc_id, i, size, item_id FROM doc_windows JOIN item_windows USING (size, win)
), hits AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS word FROM (SELECT DISTINCT doc_id, i, size FROM found)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op10_warc": r"""
WITH payloads AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), groups AS (SELECT hex, min(page_id) AS first FROM payloads GROUP BY hex
), digits AS (
  SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31)::INT + 1, 1), '' ORDER BY i, s DESC) AS digest
  FROM (SELECT hex, i, ('0x' || substr(hex, 5 * i + 1, 5))::BIGINT AS v, unnest([15, 10, 5, 0]) AS s
        FROM (SELECT hex, unnest(range(8)) AS i FROM groups)) GROUP BY hex
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM payloads JOIN groups USING (hex) JOIN digits USING (hex)""",
    "op11_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces
), totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM split GROUP BY lang
), runs AS (
  SELECT lang, words[i : i + size - 1] AS words
  FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS i
        FROM (SELECT lang, words, unnest([1, 2, 3, 4]) AS size FROM split) WHERE len(words) >= size)
), f AS (SELECT lang, words, count(*) AS f FROM runs GROUP BY lang, words HAVING count(*) >= 30
), candidates AS (SELECT lang, words, f AS a FROM f WHERE len(words) >= 2
), cuts AS (
  SELECT c.lang, c.words, c.a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f) AS score
  FROM (SELECT lang, words, a, unnest(range(1, len(words))) AS k FROM candidates) c
  JOIN f x ON x.lang = c.lang AND x.words = c.words[1 : k]
  JOIN f y ON y.lang = c.lang AND y.words = c.words[k + 1 :]
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1
), inner_runs AS (
  SELECT lang, words[i : i + size - 1] AS words, max(a) AS around
  FROM (SELECT lang, words, a, size, unnest(range(1, len(words) - size + 2)) AS i
        FROM (SELECT lang, words, a, unnest(range(2, len(words))) AS size FROM candidates WHERE len(words) >= 3))
  GROUP BY ALL
)
SELECT lang, row_number() OVER best AS rank, array_to_string(words, ' ') AS phrase, a, l, r, n, score::BIGINT AS score
FROM lowest LEFT JOIN inner_runs USING (lang, words) JOIN totals USING (lang)
WHERE around IS NULL OR 100 * around::HUGEINT < 80 * a::HUGEINT
WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' '))
QUALIFY row_number() OVER best <= 2000""",
    "op12_hard_negatives": r"""
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER choice)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW choice AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER choice <= 10""",
}
