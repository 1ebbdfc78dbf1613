"""The registered query of each training-data operator, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .bpe import bpe_decode, bpe_digests, bpe_encode, read_ranks
from .chat_format import digests, format_conversations
from .common import table
from .decontaminate import find_leaks
from .exact_dedup import exact_dedup
from .html_extract import extract_html
from .language_id import identify, train
from .ngram_join import jaccard_components
from .pii import find_pii
from .secret_scan import scan_secrets
from .sharding import TABLE_SIZE, lookup_table, place


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokenizer_file() -> tuple[str, str]:
    """Path of the byte-level ranks and the pattern that goes with them."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer_file()
    ranks = read_ranks(spark, path)
    return bpe_digests(bpe_decode(bpe_encode(table(spark, sf_dir, "documents"), ranks, pattern), ranks))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body
  FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, text_sha256
FROM t
"""


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_html(table(spark, sf_dir, "pages"))


#: Shards of the registered placement.
SHARDS = [f"shard-{i:03d}" for i in range(192)]


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents"), "doc_id", SHARDS).select("doc_id", "slot", "shard")


def op8_sql() -> str:
    """The placement with the table as a list; tests hold the table against a brute-force version."""
    owners = ",".join(map(str, lookup_table(SHARDS)))
    return (
        f"WITH own AS (SELECT string_split('{owners}', ',') AS o), "
        f"placed AS (SELECT doc_id, CASE WHEN doc_id IS NULL THEN 0 ELSE ('0x' || substring(md5(doc_id::VARCHAR), 1, 8))::BIGINT % {TABLE_SIZE} END AS slot FROM documents) "
        "SELECT doc_id, slot, 'shard-' || lpad(o[slot + 1], 3, '0') AS shard FROM placed, own"
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    own = spark.range(2).selectExpr(
        "cast(-1 as bigint) conv_id", "id turn", "if(id = 0, 'user', 'assistant') role", f"'{says}' text"
    )
    return digests(format_conversations(rows.unionByName(own)))


OP9_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
turns AS (
  SELECT *, regexp_matches(text, '\\(\[INST\]|\[/INST\]|<s>|</s>|\[ROLE:[0-9A-F]*\]|\[/ROLE\])')
         OR regexp_matches(text, ' (\[/INST\]|</s>|\[/ROLE\])') AS conflict,
         len(regexp_extract_all(text, '\[INST\]|\[/INST\]|<s>|</s>|\[ROLE:[0-9A-F]*\]|\[/ROLE\]')) AS controls,
         CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE 16 + 2 * strlen(role) END AS marks
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(text) + marks + CASE WHEN conflict THEN controls ELSE 0 END)::BIGINT AS formatted_chars,
       max(conflict::INT)::INT AS escape_level, true AS exact
FROM turns GROUP BY conv_id
"""


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


#: Every pair of documents that share a shingle is counted here, which small tables allow.
OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 3], ' ') END AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1)) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x AS doc_id, x AS r FROM sides UNION SELECT reach.doc_id, y FROM reach JOIN sides ON x = r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least_, doc_id) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS least_ FROM reach GROUP BY doc_id) USING (doc_id)
"""


def queries() -> dict:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_language_id": op2_language_id,
        "op3_decontaminate": op3_decontaminate,
        "op4_bpe": op4_bpe,
        "op5_pii": op5_pii,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_html_extract": op7_html_extract,
        "op8_sharding": op8_sharding,
        "op9_chat_format": op9_chat_format,
        "op10_ngram_join": op10_ngram_join,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": OP6_SQL, "op8_sharding": op8_sql(), "op9_chat_format": OP9_SQL, "op10_ngram_join": OP10_SQL}
