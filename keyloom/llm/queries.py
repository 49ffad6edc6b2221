"""The queries of the training-data operators: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import ann, bpe, chat, fingerprint, ngram_join, packing, substring, suffix, toxicity, warc
from keyloom.llm.common import partitions_for, sha256_text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.learn_from(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    path, pattern = P.path("byte_bpe_50k.json"), P.PATTERN
    p = packing.pack(table(spark, sf_dir, "documents"), lambda: packing.tokenizer(path, pattern).encode, end_id=1, window=2048)
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", sha256_text(F.col("kept")).alias("kept_sha256"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    read = chat.read_chats(chat.format_chats(turns))
    loss = F.array_join("loss_texts", "")
    said_all = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha256_text(said_all).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        sha256_text(loss).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read_archives(warc.write_index(warc.write_archives(table(spark, sf_dir, "pages"), least=0)))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    path, pattern = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, pattern)


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("codes", fingerprint.codes(F.col("text")))
    both = fingerprint.with_next(docs, ["text", "codes"], 4 * partitions_for(docs))
    both = both.withColumn("edited", fingerprint.edited(F.col("text"), F.col("next_text")))
    out = both.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), sha256_text(F.col("edited")).alias("edited_sha256"), "codes", fingerprint.codes(F.col("edited")).alias("edited_codes"), "next_codes")
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint.packed(F.col("codes")).alias("fingerprint"),
        fingerprint.packed(F.col("edited_codes")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"),
        fingerprint.likeness(F.col("codes"), F.col("next_codes")).alias("near_next"),
    )


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.dedup_suffixes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_packing": op2_packing,
        "op3_ngram_join": op3_ngram_join,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_chat": op5_chat,
        "op6_warc": op6_warc,
        "op7_bpe": op7_bpe,
        "op8_fingerprint": op8_fingerprint,
        "op9_ann": op9_ann,
        "op10_suffix_dedup": op10_suffix_dedup,
    }


#: DuckDB SQL where it can express the whole result and run on whole tables.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(w[i:i+49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
first AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM (SELECT doc_id, i, unnest(range(50)) AS j FROM win JOIN first USING (h) WHERE m < doc_id)),
word AS (SELECT doc_id, i, w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
kept AS (SELECT w.doc_id, count(g.i) AS n_removed, coalesce(string_agg(w.x, ' ' ORDER BY w.i) FILTER (WHERE g.i IS NULL), '') AS kept FROM word w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
OP5_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, x, CASE x WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(x)),
e AS (SELECT *, regexp_replace(replace(text, '\', '\\'), '([<\[])(\||/?s>|/?INST\]|/?SYS>|</?SYS>|BOS\]|EOS\]|PAD\]|SEP\]|CLS\]|MASK\])', '\1\\\2', 'g') AS body, lag(role) OVER w AS before, lead(role) OVER w AS after FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
f AS (SELECT *, concat(CASE WHEN before = role THEN '<|im_turn|>' ELSE concat('<|im_start|>', role, '<|im_sep|>') END, body, CASE WHEN after = role THEN '' ELSE concat('<|im_end|>', chr(10)) END) AS piece FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
CAST(sum(length(piece)) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id
"""
OP6_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST(concat('0x', substr(concat(sha, '00'), 1 + CAST(i * 5 // 4 AS INTEGER), 3)) AS INTEGER) >> CAST(7 - i * 5 % 4 AS INTEGER)) & 31), 1)), '') AS digest, max(page_id) OVER (PARTITION BY sha) AS top FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM b
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_substring_dedup": OP4_SQL, "op5_chat": OP5_SQL, "op6_warc": OP6_SQL}
