"""The registered queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, html_extract, jaccard_join, lm_scoring, quality_rules, sentencepiece_nbest, sharding, substring_dedup, token_counts
from .common import spread


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", sharding.text_size(F.col("text")).alias("size"), sharding.text_crc32(F.col("text")).alias("text_crc32"))
    return sharding.shuffle(docs, 16).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(spread(_documents(spark, sf_dir)), public_tokenizers.path("byte_bpe_50k.json"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.find(_documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], real.schema)
    return chat_format.read_back(chat_format.format_conversations(real.union(extra)))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality_rules.judge(docs, bands=quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_nbest.encode(spread(_documents(spark, sf_dir)), model, keep=("doc_id", "text"), decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        "cost",
        F.transform("others", lambda x: x["cost"]).alias("other_costs"),
        F.xxhash64("ids").alias("ids_hash"),
        (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"),
    )


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_lm_scoring, op3_token_counts, op4_substring_dedup, op5_jaccard_join, op6_chat_formatting, op7_html_extraction, op8_quality_rules, op9_sentencepiece, op10_benchmark_decontamination)}
def _escaped_chars(column: str) -> str:
    return f"(length({column}) + length(regexp_replace({column}, '[^<\\[\\\\]', '', 'g')))"


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op6_chat_formatting": f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
        SELECT conv_id, count(*)::BIGINT AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(length('<|turn|><|text|><|end|>') + {_escaped_chars("role")} + {_escaped_chars("text")})::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op5_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        sets AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
            ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingles FROM d),
        s AS MATERIALIZED (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
        links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
        reach(doc_id, other) AS (SELECT a, b FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
        SELECT sets.doc_id, len(shingles)::BIGINT AS n_shingles, least(sets.doc_id, coalesce(min(other), sets.doc_id)) AS component_id
        FROM sets LEFT JOIN reach ON reach.doc_id = sets.doc_id GROUP BY sets.doc_id, shingles""",
    "op4_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
        w AS (SELECT doc_id, words, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
        v AS (SELECT doc_id, n, word, i, CASE WHEN i + 19 <= n THEN array_to_string(list_slice(words, i, i + 19), ' ') END AS win FROM w),
        f AS (SELECT win, min({{'d': doc_id, 'i': i}}) AS first FROM v WHERE win IS NOT NULL GROUP BY win),
        g AS (SELECT v.doc_id, n, word, v.i, coalesce(first < {{'d': v.doc_id, 'i': v.i}}, false) AS later FROM v LEFT JOIN f ON v.win = f.win),
        c AS (SELECT *, bool_or(later) OVER (PARTITION BY doc_id ORDER BY i ROWS 19 PRECEDING) AS gone FROM g),
        r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
        SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN r ON d.doc_id = r.doc_id""",
}
