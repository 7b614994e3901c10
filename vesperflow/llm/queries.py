"""The registered queries of the training-data operators and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vesperflow.llm import chat, decontaminate, lm_score, order_minhash, packing, quality, secrets, simhash, tokens, toxicity
from vesperflow.session import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicate groups of all documents."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(found.fp).alias("fingerprint"), "component_id")


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-fit packing of all documents, by whole words and an end mark."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that benchmark items' windows cover."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLE_SQL["op4_decontaminate"] = rf"""
WITH items AS (SELECT DISTINCT CAST(item_id AS VARCHAR) item, {_WORDS} w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT DISTINCT item, least(len(w), 10) k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') s
            FROM items, unnest(range(1, greatest(len(w) - 10, 0) + 2)) u(i) WHERE len(w) > 0),
docs AS (SELECT doc_id, {_WORDS} w FROM documents),
spots AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') s
          FROM docs, (SELECT DISTINCT k FROM windows) ks, unnest(range(1, len(w) - k + 2)) u(i)),
found AS (SELECT doc_id, i, k, item FROM spots JOIN windows USING (k, s)),
hits AS (SELECT doc_id, count(DISTINCT j) n_hit FROM found, unnest(range(i, i + k)) u(j) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
       sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN own USING (doc_id)
"""


@query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of all documents."""
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of all documents."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query
def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token shards of all documents, written and read back."""
    import public_tokenizers

    return tokens.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], turns.schema)
    return chat.digests(chat.format_conversations(turns.unionByName(extra)))


_MARK = r"'(\\|<s>|</s>|\[INST\]|\[/INST\]|\[ROLE\]|\[TEXT\]|\[/TEXT\])'"
ORACLE_SQL["op2_chat"] = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') r, coalesce(text, '') x FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(replace(x, '\', '\\')) + 4 * len(regexp_extract_all(replace(x, '\', ''), {_MARK})) ex,
             length(replace(r, '\', '\\')) + 4 * len(regexp_extract_all(replace(r, '\', ''), {_MARK})) er FROM t)
SELECT conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, r, x)) turns_sha256,
       CAST(coalesce(sum(length(x)) FILTER (r = 'assistant'), 0) AS BIGINT) loss_chars,
       sha256(coalesce(string_agg(x, '' ORDER BY turn, r, x) FILTER (r = 'assistant'), '')) loss_sha256,
       CAST(3 + sum(CASE WHEN r = 'user' THEN 13 + ex WHEN r = 'assistant' THEN 4 + ex ELSE 19 + er + ex END) AS BIGINT) formatted_chars
FROM e GROUP BY conv_id
"""


@query
def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of all documents; the target is the documents labelled as of good quality."""
    docs = table(spark, sf_dir, "documents")
    return lm_score.score_whole(docs, table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of all documents."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash fingerprints of all documents and of their edited texts."""
    return order_minhash.edit_likeness(table(spark, sf_dir, "documents"), fill=True)
