"""The registered queries of this subpackage: thin calls of its operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.llm import byte_pairs, decontaminate, filter_audit, licences, line_rules, near_copies
from ruleweave.llm import repeated_spans, sharding, token_files, toxicity, trie_bpe, url_rules, whitening
from ruleweave.llm.common import table


def op1_simhash_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_karmarkar_karp_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op3_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_left_words", "left_text"
    )


def op4_suffix_group_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans.measure(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_hamming_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.link(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_association_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"))


def op7_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


def op8_two_tier_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_pairs.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op9_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op11_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = trie_bpe.share(spark, public_tokenizers.path("byte_bpe_50k.json"))
    read = trie_bpe.encode(table(spark, sf_dir, "documents"), shared, decoded=True)
    n_tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return read.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_spectral_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def op13_filter_survival_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ALL = {
    f.__name__: f
    for f in (
        op1_simhash_benchmark_leaks,
        op2_karmarkar_karp_shards,
        op3_line_frequency_rules,
        op4_suffix_group_spans,
        op5_hamming_near_copies,
        op6_association_url_rules,
        op7_subword_toxicity,
        op8_two_tier_bpe,
        op9_repair_token_files,
        op10_licence_scan,
        op11_trie_bpe,
        op12_spectral_whitening,
        op13_filter_survival_words,
    )
}
#: The others are mined, learnt, iterative or defined by a library; the tests hold them against brute force.
SQL: dict[str, str] = {
    "op13_filter_survival_words": """
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), docs AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    map(['A', 'B', 'C', 'D', 'E'], [
      len(words) < 200,
      100 * len(list_distinct(words)) < 50 * len(words),
      100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
      regexp_matches(text, '[#$%&*|]'),
      coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false)]) AS fails
  FROM words w LEFT JOIN marks m ON w.doc_id = m.doc_id
), kinds AS (
  SELECT part, fails['A'] AS a, fails['B'] AS b, fails['C'] AS c, fails['D'] AS d, fails['E'] AS e, any_value(fails) AS fails,
    count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM docs GROUP BY part, a, b, c, d, e
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT p.l || q.l || r.l || s.l || t.l AS filter_order
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.l, q.l, r.l, s.l, t.l])) = 5
), steps AS (
  SELECT filter_order, step, filter_order[step] AS letter, string_split(filter_order[1:step - 1], '') AS earlier,
    string_split(replace('ABCDE', filter_order[step], ''), '') AS others
  FROM orders, (SELECT unnest(range(1, 6)) AS step)
), met AS (
  SELECT part, filter_order, step, letter, n, good, toxic, fails[letter] AS failed,
    step > 1 AND len(list_filter(earlier, lambda x: x <> '' AND fails[x])) > 0 AS gone,
    len(list_filter(others, lambda x: fails[x])) > 0 AS otherwise
  FROM kinds, steps
), counted AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (NOT gone AND NOT failed), 0) AS kept,
    coalesce(sum(n) FILTER (NOT gone AND failed), 0) AS removed,
    coalesce(sum(n) FILTER (gone AND failed), 0) AS redundant,
    coalesce(sum(n) FILTER (failed AND NOT otherwise), 0) AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND failed), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (NOT gone AND failed), 0) AS toxic_lost
  FROM met GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley
FROM counted""",
}
