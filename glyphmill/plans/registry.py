"""All queries over the tokeniser's operators, with the DuckDB SQL each is held against.

The vocabulary of the queries is built from the corpus itself (operators.vocabulary). Their SQL
rebuilds it and walks words with a recursive query; the corpora of the driver hold ASCII and accented
Latin letters only, so SQL's own character functions agree with the pinned tables there, and what they
do not reach is covered by rows written into the queries and by tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernel import Config
from ..operators import encode as enc
from ..operators.basic import basic_token_rows
from ..operators.passes import token_rows
from ..operators.vocabulary import contains, get_ids, get_tokens, longest_prefix, prefix_rows, vocab_from_corpus
from ..operators.wordpiece import wordpiece_rows
from ..session import shared_path
from ..sources.tables import table
from ..sources.vocab import SPECIAL_TOKENS, Vocab
from . import goldens

LOWER, CASED = Config(), Config(lower=False)
MAX_LENGTH = 128
#: Rows whose characters the tables of the driver lack.
EDGE_ROWS = ("cost:$5.00 [SEP] x", "a\tb\u000bc", "foo[SEP]bar", "[sep]", "a‍b c", "x y", "中a文", "a！b", "a€b", "É é", "x≠y", "éx", "")
LONG_WORDS = ("a" * 100, "a" * 101, "é" * 50, "é" * 51, "short")

_VOCABS: dict[tuple[str, str], Vocab] = {}


def corpus_vocab(spark: SparkSession, sf_dir: str) -> Vocab:
    """The vocabulary of the documents, built once a session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _VOCABS:
        _VOCABS[key] = vocab_from_corpus(table(spark, sf_dir, "documents"))
    return _VOCABS[key]


def _texts(spark: SparkSession, texts) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "k int, text string")


def _flat(column: str):
    return F.array_join(F.col(column).cast("array<string>"), " ").alias(column)


def vocab_from_corpus_query(spark, sf_dir):
    return corpus_vocab(spark, sf_dir).frame(spark)


def vocab_size(spark, sf_dir):
    return corpus_vocab(spark, sf_dir).frame(spark).agg(F.count(F.lit(1)).alias("size"))


def special_ids(spark, sf_dir):
    v = corpus_vocab(spark, sf_dir)
    return spark.createDataFrame([(t, v.special_id(t)) for t in (*SPECIAL_TOKENS, "[NONE]")], "token string, id int")


def vocab_file(spark, sf_dir):
    """The corpus vocabulary as a file of lines, and loaded from it, blank lines and repeats aside."""
    v = corpus_vocab(spark, sf_dir)
    path = shared_path(spark, "vocab")
    lines = "\n".join((*v.tokens[:9], "", v.tokens[3], *v.tokens[9:], "", v.tokens[0]))
    spark.createDataFrame([(lines,)], "value string").coalesce(1).write.text(path)
    return Vocab.load(spark, path).frame(spark)


def vocab_saved(spark, sf_dir):
    v, path = corpus_vocab(spark, sf_dir), shared_path(spark, "vocab")
    v.save(spark, path)
    return Vocab.restore(spark, path).frame(spark)


def vocab_prefixes(spark, sf_dir):
    return prefix_rows(table(spark, sf_dir, "benchmark"), ["item_id"], corpus_vocab(spark, sf_dir))


def vocab_longest_prefix(spark, sf_dir):
    return longest_prefix(table(spark, sf_dir, "documents").select("doc_id", "text"), corpus_vocab(spark, sf_dir)).select("doc_id", "prefix")


def vocab_contains(spark, sf_dir):
    tokens = basic_token_rows(table(spark, sf_dir, "documents"), ["doc_id"], offsets=False)
    return contains(tokens, corpus_vocab(spark, sf_dir))


def get_id_or_unk(spark, sf_dir):
    tokens = basic_token_rows(table(spark, sf_dir, "documents"), ["doc_id"], offsets=False)
    return get_ids(tokens, corpus_vocab(spark, sf_dir))


def get_token_by_id(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("int").alias("id"))
    return get_tokens(ids, corpus_vocab(spark, sf_dir)).select("doc_id", "token")


def vocab_insert(spark, sf_dir):
    v = corpus_vocab(spark, sf_dir)
    return v.insert(["the", "a new one", "[NEW]", "a new one"]).frame(spark).where(F.col("id") >= len(v) - 1)


def basic_tokens_lower(spark, sf_dir):
    return basic_token_rows(table(spark, sf_dir, "documents"), ["doc_id"], config=LOWER, offsets=False)


def basic_tokens_cased(spark, sf_dir):
    return basic_token_rows(table(spark, sf_dir, "documents"), ["doc_id"], config=CASED, offsets=False)


def basic_token_offsets(spark, sf_dir):
    return token_rows(table(spark, sf_dir, "documents"), ["doc_id"], config=LOWER)


def basic_token_byte_offsets(spark, sf_dir):
    return token_rows(table(spark, sf_dir, "documents"), ["doc_id"], config=Config(True, False))


def char_class_edges(spark, sf_dir):
    return basic_token_rows(_texts(spark, EDGE_ROWS), ["k"], config=LOWER)


def special_token_split(spark, sf_dir):
    """Documents of which "the" is made a special token: it splits words, and keeps its case."""
    return token_rows(table(spark, sf_dir, "documents"), ["doc_id"], config=LOWER.with_specials("the"))


def _code_point(column: str):
    """The character of a code point of the first plane."""
    return F.decode(F.unhex(F.lpad(F.hex(column), 4, "0")), "UTF-16BE")


def fold_hangul(spark, sf_dir):
    """Every syllable, which folds to two or three jamo."""
    rows = spark.range(0xAC00, 0xD7A4).select("id", _code_point("id").alias("text"))
    return basic_token_rows(rows, ["id"], config=LOWER)


def fold_marks(spark, sf_dir):
    """Combining marks before, within and after letters."""
    rows = spark.range(0x300, 0x370).select("id", F.concat(_code_point("id"), F.lit("x "), F.lit("a"), _code_point("id"), F.lit("b É"), _code_point("id")).alias("text"))
    return basic_token_rows(rows, ["id"], config=LOWER)


def fold_latin(spark, sf_dir):
    """Latin letters beyond ASCII, at the end of a word."""
    rows = spark.range(0xC0, 0x250).select("id", F.concat(F.lit("Ab"), _code_point("id")).alias("text"))
    return basic_token_rows(rows, ["id"], config=LOWER)


def wordpiece_tokens(spark, sf_dir):
    return wordpiece_rows(table(spark, sf_dir, "documents"), ["doc_id"], corpus_vocab(spark, sf_dir))


def _piece_rows(spark, sf_dir, config):
    outs = {"i": "i", "piece": "strings", "start": "start", "end": "end"}
    return enc.piece_rows(table(spark, sf_dir, "documents"), ["doc_id"], corpus_vocab(spark, sf_dir), outs, config=config)


def wordpiece_offsets(spark, sf_dir):
    return _piece_rows(spark, sf_dir, LOWER)


def wordpiece_byte_offsets(spark, sf_dir):
    return _piece_rows(spark, sf_dir, Config(True, False))


def golden_encodings(spark, sf_dir):
    """The golden texts: all arrays of their encodings, and their fixed-length form."""
    out = None
    for k, (text, vocab, config, most) in enumerate(((goldens.CHINESE, goldens.chinese_vocab(), LOWER, 48), (goldens.THAI, goldens.thai_vocab(), CASED, 64))):
        rows = enc.encode_with_ids(_texts(spark, [text]), vocab, config=config, max_length=most)
        fixed = enc.encode_fixed(rows.withColumnRenamed("input_ids", "ids"), vocab, most, config=config)
        one = fixed.select(F.lit(k).alias("k"), _flat("ids"), *map(_flat, enc.ENCODING))
        out = one if out is None else out.unionByName(one)
    return out


def unk_long_words(spark, sf_dir):
    return wordpiece_rows(_texts(spark, LONG_WORDS), ["k"], Vocab((*SPECIAL_TOKENS, "a", "##a", "é", "##é")), config=CASED)


def ids_roundtrip(spark, sf_dir):
    v = corpus_vocab(spark, sf_dir)
    rows = enc.wordpiece_tokenize(_documents(spark, sf_dir), v).drop("offsets", "text")
    ids = enc.convert_tokens_to_ids(rows, v, add_cls_sep=True).drop("pieces")  # they would go to Python and back with the ids
    back = enc.convert_ids_to_tokens(ids, v)
    return back.select("doc_id", _flat("ids"), _flat("tokens"))


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def encode_fixed(spark, sf_dir):
    return enc.encode_fixed(_documents(spark, sf_dir), corpus_vocab(spark, sf_dir), MAX_LENGTH).select("doc_id", _flat("input_ids"))


def encode_with_ids(spark, sf_dir):
    rows = enc.encode_with_ids(_documents(spark, sf_dir), corpus_vocab(spark, sf_dir), max_length=MAX_LENGTH)
    return rows.select("doc_id", *map(_flat, enc.ENCODING))


def encode_truncated(spark, sf_dir):
    rows = enc.encode_with_ids(_documents(spark, sf_dir), corpus_vocab(spark, sf_dir), padding=False, max_length=16)
    return rows.select("doc_id", _flat("input_ids"), _flat("offsets"))


def encode_cut_by_padding(spark, sf_dir):
    rows = enc.encode_with_ids(_documents(spark, sf_dir), corpus_vocab(spark, sf_dir), truncation=False, max_length=16)
    return rows.select("doc_id", _flat("input_ids"), F.size("offsets").alias("n_offsets"))


def encode_nopad(spark, sf_dir):
    rows = enc.encode(_documents(spark, sf_dir), corpus_vocab(spark, sf_dir), add_cls_sep=False, truncation=False)
    return rows.select("doc_id", _flat("input_ids"))


def _batched(spark, sf_dir, **options):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return enc.encode_batch(rows, corpus_vocab(spark, sf_dir), ["conv_id"], **options).select("conv_id", "turn", _flat("input_ids"), _flat("attention_mask"))


def encode_batch_longest(spark, sf_dir):
    return _batched(spark, sf_dir)


def encode_batch_max(spark, sf_dir):
    return _batched(spark, sf_dir, padding_to_max_length=True, max_length=64)


def encode_batch_shifted(spark, sf_dir):
    return _batched(spark, sf_dir, shifted_arguments=True, padding_to_max_length=True, max_length=64)


def encode_conversations(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return enc.encode(rows, corpus_vocab(spark, sf_dir), max_length=MAX_LENGTH).select("conv_id", "turn", _flat("input_ids"))


def encode_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", "html")
    return enc.encode(rows, corpus_vocab(spark, sf_dir), "html", max_length=MAX_LENGTH).select("page_id", _flat("input_ids"))


def encode_benchmark(spark, sf_dir):
    return enc.encode(table(spark, sf_dir, "benchmark"), corpus_vocab(spark, sf_dir), max_length=MAX_LENGTH).select("item_id", _flat("input_ids"))


def longest_encoding(spark, sf_dir):
    rows = enc.encode(_documents(spark, sf_dir), corpus_vocab(spark, sf_dir), truncation=False)
    return rows.agg(F.max(F.size("input_ids")).alias("longest"))


# ---------------------------------------------------------------------------------------------- SQL

_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_PIECE = rf"\[PAD\]|\[CLS\]|\[SEP\]|\[UNK\]|\[MASK\]|{_WORD}|[!-/:-@\[-`{{-~]|[ \t\r\n]+"


def _runs(table_name: str, keys: str, text: str, lower: bool, pattern: str = _PIECE) -> str:
    """Runs of a table with positions in code points and bytes, and tokens among them numbered."""
    token = "CASE WHEN r IN ('[PAD]', '[CLS]', '[SEP]', '[UNK]', '[MASK]') THEN r ELSE strip_accents(lower(r)) END" if lower else "r"
    return f"""
runs AS (SELECT {keys}, unnest(rs) AS r, generate_subscripts(rs, 1) AS i FROM (SELECT {keys}, regexp_extract_all({text}, '{pattern}') AS rs FROM {table_name})),
placed AS (SELECT *, sum(length(r)) OVER w - length(r) AS off, sum(strlen(r)) OVER w - strlen(r) AS byte_at FROM runs WINDOW w AS (PARTITION BY {keys} ORDER BY i)),
toks AS (SELECT {keys}, (row_number() OVER (PARTITION BY {keys} ORDER BY i) - 1)::INT AS pos, off::INT AS start, (off + length(r))::INT AS "end",
                byte_at::INT AS byte_start, (byte_at + strlen(r))::INT AS byte_end, r AS said, {token} AS token
         FROM placed WHERE NOT regexp_matches(r, '^[ \\t\\r\\n]'))"""


def _vocab_sql() -> str:
    """vocab(id, token) of the documents."""
    return f"""
d_runs AS (SELECT unnest(regexp_extract_all(text, '{_PIECE}')) AS r FROM documents),
d_words AS (SELECT strip_accents(lower(r)) AS token, count(*) AS n FROM d_runs
            WHERE NOT regexp_matches(r, '^[ \\t\\r\\n]') AND r NOT IN ('[PAD]', '[CLS]', '[SEP]', '[UNK]', '[MASK]') GROUP BY 1),
d_chars AS (SELECT DISTINCT unnest(string_split(token, '')) AS c FROM d_words),
d_top AS (SELECT token, n FROM d_words WHERE length(token) > 1 ORDER BY n DESC, encode(token) LIMIT 5000),
d_ends AS (SELECT right(token, 3) AS e, sum(n) AS n FROM d_words WHERE length(token) > 3 GROUP BY 1 ORDER BY n DESC, encode(e) LIMIT 1000),
d_all AS (SELECT 1 AS part, unnest(range(5)) AS k, NULL::BLOB AS b, unnest(['[PAD]', '[CLS]', '[SEP]', '[UNK]', '[MASK]']) AS token
          UNION ALL SELECT 2, 0, encode(c), c FROM d_chars UNION ALL SELECT 3, 0, encode(c), '##' || c FROM d_chars
          UNION ALL SELECT 4, -n, encode(token), token FROM d_top UNION ALL SELECT 5, -n, encode(e), '##' || e FROM d_ends),
d_first AS (SELECT token, min((part, k, b)) AS place FROM d_all GROUP BY token),
vocab AS (SELECT (row_number() OVER (ORDER BY place) - 1)::INT AS id, token FROM d_first)"""


_PIECES_SQL = """
words AS (SELECT DISTINCT token FROM toks WHERE token <> ''),
walk AS (
  SELECT w.token, 0 AS off, 0 AS idx, CASE WHEN v.id IS NOT NULL OR w.token IN ('[PAD]', '[CLS]', '[SEP]', '[UNK]', '[MASK]') THEN w.token END AS piece,
         v.id IS NOT NULL OR w.token IN ('[PAD]', '[CLS]', '[SEP]', '[UNK]', '[MASK]') AS done
  FROM words w LEFT JOIN vocab v ON v.token = w.token
  UNION ALL
  SELECT token, off + len, idx + 1, best, coalesce(off + len >= length(token), true)
  FROM (SELECT k.token, k.off, k.idx, max_by(v.token, v.len) AS best, max(v.len) AS len
        FROM walk k LEFT JOIN pieces v ON starts_with(substring(k.token, k.off + 1), v.body) AND v.lead = (k.off > 0) AND v.head = substring(k.token, k.off + 1, 1)
        WHERE NOT k.done AND strlen(k.token) <= 100 GROUP BY k.token, k.off, k.idx)),
"""


def _wordpiece_sql() -> str:
    """split(token, idx, piece, from, to): the pieces of each distinct token of toks."""
    return (
        _PIECES_SQL
        + """
ended AS (SELECT token, max(off) AS off, count(*) FILTER (idx > 0 AND piece IS NULL) AS bad FROM walk GROUP BY token),
good AS (SELECT token FROM ended e WHERE bad = 0 AND off = length(token)),
split AS (SELECT token, 0 AS idx, piece, 0 AS "from", length(token) AS "to", true AS whole FROM walk WHERE idx = 0 AND done
          UNION ALL SELECT k.token, k.idx - 1, k.piece, k.off - (length(k.piece) - CASE WHEN k.idx > 1 THEN 2 ELSE 0 END), k.off, false
                    FROM walk k JOIN good USING (token) WHERE k.idx > 0
          UNION ALL SELECT token, 0, '[UNK]', 0, length(token), true FROM walk WHERE idx = 0 AND NOT done AND token NOT IN (SELECT token FROM good))"""
    )


def _with_pieces(table_name: str, keys: str, text: str) -> str:
    return (
        "WITH RECURSIVE "
        + _runs(table_name, keys, text, True)
        + ","
        + _vocab_sql()
        + """,
pieces AS (SELECT id, token, starts_with(token, '##') AND length(token) > 2 AS lead,
                  CASE WHEN starts_with(token, '##') AND length(token) > 2 THEN substring(token, 3) ELSE token END AS body, length(body) AS len, substring(body, 1, 1) AS head FROM vocab),
"""
        + _wordpiece_sql()
        + f""",
found AS (SELECT {keys}, pos, idx AS piece_idx, piece, start + "from" AS start, CASE WHEN whole THEN "end" ELSE start + "to" END AS "end",
                 byte_start + strlen(substring(said, 1, "from")) AS byte_from, CASE WHEN whole THEN byte_end ELSE byte_start + strlen(substring(said, 1, "to")) END AS byte_to,
                 coalesce(v.id, (SELECT id FROM vocab WHERE token = '[UNK]')) AS id
          FROM toks JOIN split USING (token) LEFT JOIN vocab v ON v.token = split.piece),
ids AS (SELECT {keys}, list(id ORDER BY pos, piece_idx) AS ids, flatten(list([start, "end"] ORDER BY pos, piece_idx)) AS offsets FROM found GROUP BY {keys}),
coded AS (SELECT {keys}, coalesce(ids, []) AS ids, coalesce(offsets, []) AS offsets FROM (SELECT {keys} FROM {table_name}) LEFT JOIN ids USING ({keys})),
own AS (SELECT (SELECT id FROM vocab WHERE token = '[CLS]') AS cls, (SELECT id FROM vocab WHERE token = '[SEP]') AS sep)
"""
    )


_JOIN = "array_to_string({}, ' ')"


def _cut(n: int) -> str:
    return f"CASE WHEN len(ids) + 2 > {n} THEN list_concat([cls], ids[:{n - 2}], [sep]) ELSE list_concat([cls], ids, [sep]) END"


def _filled(expr: str, n: int | str, fill: int = 0) -> str:
    return f"list_resize({expr}, {n}, {fill})"


def _quoted(ints) -> str:
    return "'" + " ".join(map(str, ints)) + "'"


def oracle_sql() -> dict[str, str]:
    docs, bench, conv = _with_pieces("documents", "doc_id", "text"), _with_pieces("benchmark", "item_id", "text"), _with_pieces("conversations", "conv_id, turn", "text")
    pages = _with_pieces("pages", "page_id", "html")
    edge = "(VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(LONG_WORDS)) + ") AS t(k, text)"
    vocab = "WITH " + _vocab_sql()
    m = MAX_LENGTH
    tokens_of = lambda lower: "WITH " + _runs("documents", "doc_id", "text", lower)
    doc_tokens = "WITH " + _runs("documents", "doc_id", "text", True) + "," + _vocab_sql()
    lengths = ", lens AS (SELECT DISTINCT length(token) AS n FROM vocab)"
    golden = " UNION ALL ".join(
        f"SELECT {k} AS k, {', '.join(f'{_quoted(x)} AS {c}' for c, x in zip(('ids', *enc.ENCODING), (full, full, [0] * most, [1] * len(ids) + [0] * (most - len(ids)), at), strict=True))}"
        for k, (ids, at, most) in enumerate(((goldens.CHINESE_IDS, goldens.CHINESE_OFFSETS, 48), (goldens.THAI_IDS, goldens.THAI_OFFSETS, 64)))
        for full in [ids + [0] * (most - len(ids))]
    )
    split_the = _PIECE.replace(r"\[MASK\]|", r"\[MASK\]|the|")
    mask = f"list_concat(list_resize(CAST([] AS INT[]), least(len(ids) + 2, {m}), 1), list_resize(CAST([] AS INT[]), greatest(0, {m} - len(ids) - 2), 0))"
    return {
        "vocab_from_corpus": vocab + " SELECT id, token FROM vocab",
        "vocab_size": vocab + " SELECT count(*) AS size FROM vocab",
        "special_ids": vocab + ", s AS (SELECT unnest(['[PAD]', '[CLS]', '[SEP]', '[UNK]', '[MASK]', '[NONE]']) AS token) SELECT token, coalesce(id, -1)::INT AS id FROM s LEFT JOIN vocab USING (token)",
        "vocab_file": vocab + " SELECT id, token FROM vocab",
        "vocab_saved": vocab + " SELECT id, token FROM vocab",
        "vocab_prefixes": vocab + lengths + ", spots AS (SELECT item_id, text, unnest(range(length(text))) AS pos FROM benchmark) "
        "SELECT item_id, pos::INT AS pos, v.token, v.id FROM spots CROSS JOIN lens JOIN vocab v ON v.token = substring(spots.text, (spots.pos + 1)::INT, lens.n::INT) WHERE pos + n <= length(text)",
        "vocab_longest_prefix": vocab + lengths + ", cut AS (SELECT doc_id, substring(text, 1, n::INT) AS head FROM documents, lens WHERE n <= length(text)), "
        "best AS (SELECT doc_id, max_by(head, length(head)) AS prefix FROM cut JOIN vocab ON token = head GROUP BY doc_id) "
        "SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(prefix, '') END AS prefix FROM documents LEFT JOIN best USING (doc_id)",
        "fold_hangul": "SELECT k::BIGINT AS id, 0 AS pos, 0 AS start, 1 AS \"end\", chr((4352 + (k - 44032) // 588)::INT) || chr((4449 + (k - 44032) % 588 // 28)::INT) || "
        "CASE WHEN (k - 44032) % 28 > 0 THEN chr((4519 + (k - 44032) % 28)::INT) ELSE '' END AS token FROM range(44032, 55204) AS t(k)",
        "fold_marks": "SELECT k::BIGINT AS id, pos, start, \"end\", strip_accents(lower(replace(said, '*', chr(k::INT)))) AS token "
        "FROM range(768, 880) AS t(k), (VALUES (0, 0, 2, '*x'), (1, 3, 6, 'a*b'), (2, 7, 9, 'É*')) AS w(pos, start, \"end\", said)",
        "fold_latin": "SELECT k::BIGINT AS id, 0 AS pos, 0 AS start, 3 AS \"end\", strip_accents(lower('Ab' || chr(k::INT))) AS token FROM range(192, 592) AS t(k)",
        "golden_encodings": golden,
        "vocab_contains": doc_tokens + " SELECT doc_id, pos, toks.token, v.id IS NOT NULL AS known FROM toks LEFT JOIN vocab v USING (token)",
        "get_id_or_unk": doc_tokens + " SELECT doc_id, pos, toks.token, coalesce(v.id, 3)::INT AS id FROM toks LEFT JOIN vocab v USING (token)",
        "get_token_by_id": vocab + " SELECT doc_id, token FROM documents LEFT JOIN vocab ON id = doc_id",
        "vocab_insert": vocab + """ SELECT id, token FROM vocab WHERE id = (SELECT max(id) FROM vocab)
            UNION ALL SELECT ((SELECT max(id) FROM vocab) + row_number() OVER (ORDER BY o))::INT, t FROM (VALUES (1, 'the'), (2, 'a new one'), (3, '[NEW]')) AS n(o, t) WHERE t NOT IN (SELECT token FROM vocab)""",
        "basic_tokens_lower": tokens_of(True) + " SELECT doc_id, pos, token FROM toks",
        "basic_tokens_cased": tokens_of(False) + " SELECT doc_id, pos, token FROM toks",
        "basic_token_offsets": tokens_of(True) + ' SELECT doc_id, pos, start, "end", token FROM toks',
        "basic_token_byte_offsets": tokens_of(True) + ' SELECT doc_id, pos, byte_start AS start, byte_end AS "end", token FROM toks',
        "char_class_edges": """SELECT k::INT AS k, pos::INT AS pos, start::INT AS start, "end"::INT AS "end", token FROM (VALUES
            (0, 0, 0, 4, 'cost'), (0, 1, 4, 5, ':'), (0, 2, 5, 6, '$'), (0, 3, 6, 7, '5'), (0, 4, 7, 8, '.'), (0, 5, 8, 10, '00'), (0, 6, 11, 16, '[SEP]'), (0, 7, 17, 18, 'x'),
            (1, 0, 0, 1, 'a'), (1, 1, 2, 5, 'bc'), (2, 0, 0, 3, 'foo'), (2, 1, 3, 8, '[SEP]'), (2, 2, 8, 11, 'bar'), (3, 0, 0, 1, '['), (3, 1, 1, 4, 'sep'), (3, 2, 4, 5, ']'),
            (4, 0, 0, 3, 'ab'), (4, 1, 4, 5, 'c'), (5, 0, 0, 1, 'x'), (5, 1, 2, 3, 'y'), (6, 0, 0, 1, '中'), (6, 1, 1, 2, 'a'), (6, 2, 2, 3, '文'), (7, 0, 0, 1, 'a'), (7, 1, 1, 2, '！'), (7, 2, 2, 3, 'b'),
            (8, 0, 0, 3, 'a€b'), (9, 0, 0, 1, 'e'), (9, 1, 2, 3, 'e'), (10, 0, 0, 1, 'x'), (10, 1, 1, 2, '='), (10, 2, 2, 3, 'y'), (11, 0, 0, 3, 'ex')) AS t(k, pos, start, "end", token)""",
        "special_token_split": "WITH RECURSIVE cut AS (SELECT doc_id, unnest(string_split(text, 'the')) AS part, generate_subscripts(string_split(text, 'the'), 1) AS g FROM documents), "
        "bits AS (SELECT doc_id, g, part AS body, 0 AS sp FROM cut UNION ALL SELECT doc_id, g, 'the', 1 FROM cut WHERE g > 1), "
        f"rs AS (SELECT doc_id, g, sp, unnest(CASE WHEN sp = 1 THEN ['the'] ELSE regexp_extract_all(body, '{_PIECE}') END) AS r, generate_subscripts(CASE WHEN sp = 1 THEN ['the'] ELSE regexp_extract_all(body, '{_PIECE}') END, 1) AS i FROM bits), "
        "placed AS (SELECT *, sum(length(r)) OVER w - length(r) AS off FROM rs WINDOW w AS (PARTITION BY doc_id ORDER BY g, 1 - sp, i ROWS UNBOUNDED PRECEDING)) "
        "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY off) - 1)::INT AS pos, off::INT AS start, (off + length(r))::INT AS \"end\", strip_accents(lower(r)) AS token "
        "FROM placed WHERE NOT regexp_matches(r, '^[ \\t\\r\\n]')",
        "wordpiece_tokens": docs + " SELECT doc_id, pos, piece_idx, piece FROM found",
        "wordpiece_offsets": docs + ' SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos, piece_idx) - 1)::INT AS i, piece, start::INT AS start, "end"::INT AS "end" FROM found',
        "wordpiece_byte_offsets": docs + ' SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos, piece_idx) - 1)::INT AS i, piece, byte_from::INT AS start, byte_to::INT AS "end" FROM found',
        "unk_long_words": f"""SELECT k, 0 AS pos, (i - 1)::INT AS piece_idx, CASE WHEN strlen(text) > 100 OR NOT regexp_matches(text, '^(a+|é+)$') THEN '[UNK]' WHEN i = 1 THEN text[1] ELSE '##' || text[1] END AS piece
            FROM (SELECT k, text, unnest(range(1, CASE WHEN strlen(text) > 100 OR NOT regexp_matches(text, '^(a+|é+)$') THEN 2 ELSE length(text) + 1 END)) AS i FROM {edge})""",
        "ids_roundtrip": docs + f", b AS (SELECT doc_id, list_concat([cls], ids, [sep]) AS x FROM coded, own) SELECT doc_id, {_JOIN.format('x')} AS ids, {_JOIN.format('list_transform(x, lambda i: l[i + 1])')} AS tokens FROM b, (SELECT list(token ORDER BY id) AS l FROM vocab)",
        "encode_fixed": docs + f" SELECT doc_id, {_JOIN.format(_filled(_cut(m), m))} AS input_ids FROM coded, own",
        "encode_with_ids": docs + f" SELECT doc_id, {_JOIN.format(_filled(_cut(m), m))} AS input_ids, {_JOIN.format(_filled('CAST([] AS INT[])', m))} AS token_type_ids, {_JOIN.format(mask)} AS attention_mask, {_JOIN.format(f'offsets[:{2 * (m - 2)}]')} AS offsets FROM coded, own",
        "encode_truncated": docs + f" SELECT doc_id, {_JOIN.format(_cut(16))} AS input_ids, {_JOIN.format('offsets[:28]')} AS offsets FROM coded, own",
        "encode_cut_by_padding": docs + f" SELECT doc_id, {_JOIN.format(_filled('list_concat([cls], ids, [sep])', 16))} AS input_ids, len(offsets)::INT AS n_offsets FROM coded, own",
        "encode_nopad": docs + f" SELECT doc_id, {_JOIN.format('ids')} AS input_ids FROM coded",
        "encode_batch_longest": conv + f", l AS (SELECT conv_id, turn, {_cut(512)} AS x, max(len(x)) OVER (PARTITION BY conv_id) AS most FROM coded, own) SELECT conv_id, turn, {_JOIN.format(_filled('x', 'most'))} AS input_ids, {_JOIN.format('list_concat(list_transform(x, lambda i: 1), list_resize(CAST([] AS INT[]), most - len(x), 0))')} AS attention_mask FROM l",
        "encode_batch_max": conv + f", l AS (SELECT conv_id, turn, {_cut(64)} AS x FROM coded, own) SELECT conv_id, turn, {_JOIN.format(_filled('x', 64))} AS input_ids, {_JOIN.format('list_concat(list_transform(x, lambda i: 1), list_resize(CAST([] AS INT[]), 64 - len(x), 0))')} AS attention_mask FROM l",
        "encode_batch_shifted": conv + f", l AS (SELECT conv_id, turn, {_cut(512)} AS x FROM coded, own) SELECT conv_id, turn, {_JOIN.format(_filled('x', 512) + '[:64]')} AS input_ids, {_JOIN.format('list_concat(list_transform(x, lambda i: 1), list_resize(CAST([] AS INT[]), 512 - len(x), 0))[:64]')} AS attention_mask FROM l",
        "encode_conversations": conv + f" SELECT conv_id, turn, {_JOIN.format(_cut(m))} AS input_ids FROM coded, own",
        "encode_pages": pages + f" SELECT page_id, {_JOIN.format(_cut(m))} AS input_ids FROM coded, own",
        "encode_benchmark": bench + f" SELECT item_id, {_JOIN.format(_cut(m))} AS input_ids FROM coded, own",
        "longest_encoding": docs + " SELECT max(len(ids) + 2)::INT AS longest FROM coded",
    }


def queries() -> dict:
    own = {"vocab_from_corpus": vocab_from_corpus_query}
    for f in (
        vocab_size, vocab_file, vocab_saved, vocab_prefixes, vocab_longest_prefix, fold_hangul, fold_marks, fold_latin, golden_encodings, special_ids, vocab_contains, get_id_or_unk, get_token_by_id, vocab_insert, basic_tokens_lower, basic_tokens_cased, basic_token_offsets,
        basic_token_byte_offsets, char_class_edges, special_token_split, wordpiece_tokens, wordpiece_offsets, wordpiece_byte_offsets, unk_long_words, ids_roundtrip, encode_fixed,
        encode_with_ids, encode_truncated, encode_cut_by_padding, encode_nopad, encode_batch_longest, encode_batch_max, encode_batch_shifted, encode_conversations, encode_pages,
        encode_benchmark, longest_encoding,
    ):
        own[f.__name__] = f
    return own
