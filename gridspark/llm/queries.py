"""The registered queries of this subpackage and the SQL that checks them.

Each query applies its operator with production parameters to the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridspark.llm import decontaminate, jaccard_join, kneser_ney, language_id, mixing, quality_rules, suffix_dedup, token_store, warc, weak_labels

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(_documents(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(_documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(_documents(spark, sf_dir))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivative_report(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_report(_documents(spark, sf_dir), tokenizer_path())


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_report(_documents(spark, sf_dir))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.lm_report(_documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_documents(spark, sf_dir))


def op10_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.quality_scores(_documents(spark, sf_dir))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_quality_rules, op2_suffix_dedup, op3_language_id, op4_warc, op5_token_store, op6_jaccard_join, op7_decontaminate, op8_kneser_ney, op9_mixing, op10_weak_labels)}
#: Operator 1 in SQL: the same statistics, sketches, quartiles and limits.
_QUALITY = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, lang, source FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY rid, k) AS c FROM g) WHERE c > 1) GROUP BY rid),
s AS (SELECT w.rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  CAST(len(ls) AS BIGINT) AS n_lines, length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS n_letters,
  length(regexp_replace(t, '[^0-9]+', '', 'g')) AS n_digits FROM w LEFT JOIN r ON r.rid = w.rid),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
m AS (SELECT *, unnest([{'rule': 'odd', 'num': word_chars - n_letters - n_digits, 'den': word_chars}, {'rule': 'upper', 'num': n_upper, 'den': n_letters}, {'rule': 'long_words', 'num': word_chars, 'den': n_words},
  {'rule': 'short_words', 'num': n_words, 'den': word_chars}, {'rule': 'repeat', 'num': n_repeat_words, 'den': n_words}, {'rule': 'dup_line', 'num': n_dup_lines, 'den': n_lines}]) AS q FROM f),
b AS (SELECT rid, lang, source, base_failed, q.rule AS rule, CAST(1000000 * q.num // greatest(q.den, 1) AS BIGINT) AS v FROM m),
h AS (SELECT *, v - v % (1::BIGINT << greatest(0, length(bin(v)) - 10)) AS bin FROM b WHERE NOT base_failed AND v > 0),
o AS (SELECT 0 AS level, lang, source, rule, bin FROM h UNION ALL SELECT 1, lang, NULL, rule, bin FROM h UNION ALL SELECT 2, NULL, NULL, rule, bin FROM h),
n AS (SELECT level, lang, source, rule, bin, count(*) AS n FROM o GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rule ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY level, lang, source, rule) AS total FROM n),
l AS (SELECT level, lang, source, rule, max(total) AS total, min(CASE WHEN upto * 4 >= total * 2 THEN bin END) AS mid, min(CASE WHEN upto * 4 >= total * 3 THEN bin END) AS q FROM c GROUP BY 1, 2, 3, 4),
e AS (SELECT level, lang, source, rule, CAST(total AS DOUBLE) AS total, CAST(mid AS DOUBLE) AS mid, CAST(q + (1::BIGINT << greatest(0, length(bin(q)) - 10)) AS DOUBLE) AS high FROM l),
u AS (SELECT a.lang, a.source, a.rule, (a.total * a.mid + 20 * ((k.total * k.mid + 20 * z.mid) / (k.total + 20))) / (a.total + 20) AS mid, (a.total * a.high + 20 * ((k.total * k.high + 20 * z.high) / (k.total + 20))) / (a.total + 20) AS high
  FROM e a JOIN e k ON k.level = 1 AND k.rule = a.rule AND k.lang IS NOT DISTINCT FROM a.lang JOIN e z ON z.level = 2 AND z.rule = a.rule WHERE a.level = 0),
x AS (SELECT lang, source, rule, CAST(floor(mid + 12 * (high - mid)) AS BIGINT) AS lim FROM u),
y AS (SELECT lang, source, max(CASE WHEN rule = 'odd' THEN lim END) AS max_odd, max(CASE WHEN rule = 'upper' THEN lim END) AS max_upper, max(CASE WHEN rule = 'long_words' THEN lim END) AS max_long_words,
  max(CASE WHEN rule = 'short_words' THEN lim END) AS max_short_words, max(CASE WHEN rule = 'repeat' THEN lim END) AS max_repeat, max(CASE WHEN rule = 'dup_line' THEN lim END) AS max_dup_line FROM x GROUP BY 1, 2),
j AS (SELECT b.rid, bool_and(x.lim IS NULL OR b.v <= x.lim) AS ok FROM b LEFT JOIN x ON x.rule = b.rule AND x.lang IS NOT DISTINCT FROM b.lang AND x.source IS NOT DISTINCT FROM b.source GROUP BY 1)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND j.ok AS kept, max_odd, max_upper, max_long_words, max_short_words, max_repeat, max_dup_line
FROM f JOIN j ON j.rid = f.rid LEFT JOIN y ON y.lang IS NOT DISTINCT FROM f.lang AND y.source IS NOT DISTINCT FROM f.source
"""

ORACLES: dict[str, str] = {"op1_quality_rules": _QUALITY}
