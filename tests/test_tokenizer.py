import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.functions import unicode_tables as u
from glyphmill.functions.kernel import Config, Tokenizer
from glyphmill.functions.register import register
from glyphmill.operators import encode as E
from glyphmill.operators.basic import basic_token_rows, basic_tokenize
from glyphmill.operators.vocabulary import contains, get_ids, get_tokens, longest_prefix, prefix_rows, vocab_from_corpus
from glyphmill.operators.wordpiece import wordpiece_rows
from glyphmill.plans import goldens as G
from glyphmill.sources import tables
from glyphmill.sources.vocab import Vocab
from glyphmill.streaming.encode import encode_folder

from . import fixtures as fx
from .oracle import basic

EDGE = Vocab(tuple(fx.EDGE))
ALPHABET = list("aZ09 .,$[]-\t\n") + ["\u000b", "‍", "­", " ", "é", "É", "ß", "́", "İ", "Σ", "中", "﫚", "한", "가", "！", "€", "≠", " ", "😀", "\U0001d15e", "[SEP]", "[MASK]", "क़", "ﬁ"]


def test_tables():
    assert u.category(0x1DFA) == "Mn" and u.category(0x61D) == "Po" and u.category(0x0CF3) == "Cn"
    assert u.fold_hangul("한") == unicodedata.normalize("NFD", "한") and u.fold_hangul("가") == unicodedata.normalize("NFD", "가")
    assert sum(len(v) > 1 for v in u.fold_table().values()) == 43


@pytest.mark.parametrize("text,lower,want", fx.BASIC)
def test_basic_kernel(text, lower, want):
    assert Tokenizer(EDGE, Config(lower)).basic(text) == want == basic(text, lower)


def test_basic_column(spark):
    for lower in (True, False):
        cases = [(t, w) for t, low, w in fx.BASIC if low == lower]
        df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "k int, text string")
        got = {r.k: [tuple(x) for x in r.tokens] for r in basic_tokenize(df, config=Config(lower)).collect()}
        assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_user_special_splits_mid_word(spark):
    config = Config().with_specials("abc")
    want = [(0, 1, "x"), (1, 4, "abc"), (4, 5, "x")]
    assert Tokenizer(EDGE, config).basic("xabcx") == want
    df = spark.createDataFrame([("xabcx",), ("x\u0001abc\u0001 abc",)], "text string")
    got = [[tuple(x) for x in r.tokens] for r in basic_tokenize(df, config=config).collect()]
    assert got == [want, [tuple(x) for x in Tokenizer(EDGE, config).basic("x\u0001abc\u0001 abc")]]


def test_long_word_and_nul(spark):
    df = spark.createDataFrame([("a" * 200_000,), ("a\0b",), (None,)], "text string")
    got = [r.tokens for r in basic_tokenize(df).collect()]
    assert [tuple(x) for x in got[0]] == [(0, 200_000, "a" * 200_000)] and [tuple(x) for x in got[1]] == [(0, 1, "a")] and got[2] is None
    keep = basic_tokenize(df, config=Config(stop_at_nul=False)).collect()[1].tokens
    assert [tuple(x) for x in keep] == [(0, 3, "ab")]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join), st.booleans())
def test_kernel_against_oracle(text, lower):
    assert Tokenizer(EDGE, Config(lower)).basic(text) == basic(text, lower)


def test_token_strings_and_prefixes(spark):
    """Tokens without places, and prefixes against every substring."""
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(30))) for _ in range(300)] + ["Éa, B-c ÀÖ", "x" * 5000, None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "k int, text string, pos string")
    for lower in (True, False):
        got = {}
        for r in basic_token_rows(df, ["k"], config=Config(lower), offsets=False).collect():
            got.setdefault(r.k, []).append((r.pos, r.token))
        tk = Tokenizer(EDGE, Config(lower))
        assert all(sorted(got.get(i, [])) == [(p, x[2]) for p, x in enumerate(tk.basic(t))] for i, t in enumerate(texts) if t is not None) and len(texts) - 1 not in got
    found = {(r.k, r.pos, r.token, r.id) for r in prefix_rows(df, ["k"], EDGE).collect()}
    assert found == {(i, p, w, k) for i, t in enumerate(texts) if t for p in range(len(t)) for k, w in enumerate(EDGE.tokens) if t.startswith(w, p)}
    best = {r.k: r.prefix for r in longest_prefix(df.withColumn("best", F.lit(1)), EDGE).collect()}
    assert best == {i: None if t is None else max((w for w in EDGE.tokens if t.startswith(w)), key=len, default="") for i, t in enumerate(texts)}


def test_clashing_columns(spark):
    """No name that a caller has is one that a plan uses inside."""
    names = ("_token", "_id", "_longest", "longest", "token", "id", "c0", "b0", "v_by", "v_get", "value", "w", "i", "k0", "best", "tokens")
    df = spark.createDataFrame([(1, "a b", 13, "a"), (1, "c", 99, "?")], "b int, text string, n int, t string").withColumns({x: F.lit(x) for x in names})
    assert {r.found for r in get_ids(df, EDGE, "t", "found").collect()} == {13, 1} and {r.known for r in contains(df, EDGE, "t").collect()} == {True, False}
    assert {r.token for r in get_tokens(df, EDGE, "n").collect()} == {"a", None}
    rows = E.encode_batch(df, EDGE, ["b"]).collect()
    assert {tuple(r.input_ids) for r in rows} == {(2, 13, 14, 3), (2, 15, 3, 0)} and all(r[x] == x for r in rows for x in names)
    assert len(basic_token_rows(df, ["b", "tokens"]).collect()) == 3 and len(wordpiece_rows(df, ["b", "w", "i"], EDGE).collect()) == 3


def test_truncation_reads_no_further(spark):
    """Encodings cut at max_length are those of the whole text, cut."""
    rnd = random.Random(6)
    for config in (Config(), Config(True, False), Config(False)):
        tk = Tokenizer(EDGE, config)
        for _ in range(200):
            text = "".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(60)))
            most, cls = rnd.randrange(2, 12), rnd.random() < 0.5
            pieces, offsets = tk.wordpiece(text)
            ids = tk.token_ids(pieces, cls)
            cut = ids if len(ids) <= most else [*ids[: most - 1], tk.vocab.sep_id if cls else ids[most - 1]]
            assert tk.encode(text, cls, True, most) == cut
            assert tk.encode_with_ids(text, cls, False, True, most)[3] == (offsets if len(ids) <= most else offsets[: 2 * (most - 2 * cls)])


def test_large_vocabulary_and_close(spark, monkeypatch):
    monkeypatch.setattr(E, "MAX_BROADCAST_TOKENS", 5)
    df = spark.createDataFrame([(1, "a")], "k int, text string")
    with pytest.raises(ValueError):
        E.encode(df, EDGE)
    monkeypatch.undo()
    rows = E.encode(df, EDGE)
    assert rows.count() == 1 and E._OPEN
    E.close()
    assert not E._OPEN and rows.first().input_ids == [2, 13, 3]


def test_column_against_kernel(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(60))) for _ in range(400)] + ["word, " * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for lower in (True, False):
        for level in (True, False):
            config = Config(lower, level)
            tk = Tokenizer(EDGE, config)
            got = {r.k: [tuple(x) for x in r.tokens] for r in basic_tokenize(df, config=config).collect()}
            assert all(got[i] == tk.basic(t) for i, t in enumerate(texts))


@pytest.mark.parametrize("text,lower,pieces,ids,offsets", fx.PIECES)
def test_pieces(text, lower, pieces, ids, offsets):
    tk = Tokenizer(EDGE, Config(lower))
    assert tk.wordpiece(text) == (pieces, offsets) and tk.token_ids(pieces) == ids


def test_byte_offsets():
    assert Tokenizer(EDGE, Config(True, False)).wordpiece("éx")[1] == [0, 3, 3, 4]


@pytest.mark.parametrize("text,most,cls,pad,cut,ids,real,offsets", fx.ENCODINGS)
def test_encodings(text, most, cls, pad, cut, ids, real, offsets):
    got = Tokenizer(EDGE).encode_with_ids(text, cls, pad, cut, most)
    assert got == (ids, [0] * len(ids), [1] * real + [0] * (len(ids) - real), offsets)


def test_max_length_is_checked():
    with pytest.raises(ValueError):
        Tokenizer(EDGE).encode("a", max_length=1)


@pytest.mark.parametrize("name", ["chinese", "thai"])
def test_goldens(spark, name):
    text, vocab, lower, most, ids = (G.CHINESE, G.chinese_vocab(), True, 48, G.CHINESE_IDS) if name == "chinese" else (G.THAI, G.thai_vocab(), False, 64, G.THAI_IDS)
    offsets = [x for i in range(15) for x in (i, i + 1)] if name == "chinese" else G.THAI_OFFSETS
    v, df = vocab, spark.createDataFrame([(text,)], "text string")
    r = E.encode_with_ids(df, v, config=Config(lower), max_length=most).first()
    assert r.input_ids == ids + [0] * (most - len(ids)) and r.offsets == offsets
    assert r.token_type_ids == [0] * most and r.attention_mask == [1] * len(ids) + [0] * (most - len(ids))
    assert E.encode_fixed(df, v, most, config=Config(lower)).first().input_ids == r.input_ids
    pieces = E.wordpiece_tokenize(df, v, config=Config(lower)).first().pieces
    assert [v.id_of(p) for p in pieces] == ids[1:-1]


def test_join_plan_equals_fused_plan(spark):
    rnd = random.Random(8)
    bits = ["un", "aff", "able", "a", "b", "é", "É", "한", " ", ", ", "hello", "world", "[SEP]", "́", "z", "foo", "‍"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(25))) for _ in range(300)] + ["", "a" * 150]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    want = {r.k: r.pieces for r in E.wordpiece_tokenize(df, EDGE).collect()}
    rows = wordpiece_rows(df, ["k"], EDGE).collect()
    got = {i: [] for i in range(len(texts))}
    for r in sorted(rows, key=lambda r: (r.k, r.pos, r.piece_idx)):
        got[r.k].append(r.piece)
    assert got == want


def test_batches(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a b c"), (2, "a b"), (None, "c")], "b int, text string")
    got = {(r.b, r.text): r.input_ids for r in E.encode_batch(df, EDGE, ["b"]).collect()}
    assert got == {(1, "a"): [2, 13, 3, 0, 0], (1, "a b c"): [2, 13, 14, 15, 3], (2, "a b"): [2, 13, 14, 3], (None, "c"): [2, 15, 3]}
    assert {len(r.input_ids) for r in E.encode_batch(df, EDGE, []).collect()} == {5}
    assert {len(r.attention_mask) for r in E.encode_batch(df, EDGE, ["b"], padding_to_max_length=True, max_length=20).collect()} == {20}
    assert {len(r.input_ids) for r in E.encode_batch(df, EDGE, ["b"], shifted_arguments=True).collect()} == {512}


def test_vocabulary(spark, tmp_path):
    load = lambda data, **k: (p := tmp_path / "v.txt").write_bytes(data) and Vocab.load(spark, str(p), **k).tokens
    assert load(b"x\nx\n\ny\n") == ("x", "y") and load(b"x\ny") == ("x", "y")
    assert load(b"a\r\nb\n\nc\rd\na\n") == ("a\r", "b", "c\rd", "a") and load(b"a\r\nb\n", strip_cr=True) == ("a", "b")
    empty = Vocab()
    assert (empty.pad_id, empty.cls_id, empty.sep_id, empty.unk_id, empty.mask_id) == (-1,) * 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        Vocab.load(spark, str(tmp_path / "absent"))
    more = EDGE.insert(["zz", "a", "yy"])
    assert len(more) == len(EDGE) + 2 and more.id_of("yy") == len(EDGE) + 1 and more.id_of("?") == more.unk_id and more.count("zz") and not more.count("?")
    with pytest.raises(IndexError):
        more.token_of(999)
    df = spark.createDataFrame([("a",), ("?",), (None,)], "token string")
    assert {r.token: r.id for r in get_ids(df, EDGE).collect()} == {"a": 13, "?": 1, None: 1}
    assert {r.token: r.known for r in contains(df, EDGE).collect()} == {"a": True, "?": False, None: False}
    ids = spark.createDataFrame([(13,), (99,), (-1,)], "id int")
    assert {r.id: r.token for r in get_tokens(ids, EDGE).collect()} == {13: "a", 99: None, -1: None}
    EDGE.save(spark, str(tmp_path / "vocab"))
    assert Vocab.restore(spark, str(tmp_path / "vocab")) == EDGE


def test_conversions(spark):
    df = spark.createDataFrame([(["a", "??", "b"],), ([],), (None,)], "pieces array<string>")
    rows = E.convert_tokens_to_ids(df, EDGE, add_cls_sep=True).collect()
    assert [r.ids for r in rows] == [[2, 13, 1, 14, 3], [2, 3], None]
    back = E.convert_ids_to_tokens(E.convert_tokens_to_ids(df, EDGE), EDGE).collect()
    assert [r.tokens for r in back] == [["a", "[UNK]", "b"], [], None]


def test_corpus_vocabulary(spark):
    df = spark.createDataFrame([("bb aa aa abcd",), ("abcd, aa",)], "text string")
    v = vocab_from_corpus(df, words=2, suffixes=1)
    assert v.tokens[5:] == (",", "a", "b", "c", "d", "##,", "##a", "##b", "##c", "##d", "aa", "abcd", "##bcd")


def test_sql_functions_and_stream(spark, tmp_path):
    register(spark, EDGE, prefix="t_")
    r = spark.sql("select t_wordpiece('unaffable, a') p, t_wordpiece_offsets('a b') o, t_encode_ids('a b c', 4) i, t_token_count('a b') n").first()
    assert r.p == ["un", "##aff", "##able", ",", "a"] and r.o == [0, 1, 2, 3] and r.i == [2, 13, 14, 3] and r.n == 2
    df = spark.createDataFrame([(1, "a b"), (2, None)], "k int, text string")
    df.write.parquet(str(tmp_path / "in"))
    q = encode_folder(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out"), str(tmp_path / "cp"), EDGE, max_length=6)
    q.awaitTermination(60)
    got = {r.k: r.input_ids for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: [2, 13, 14, 3, 0, 0], 2: None}


def test_tokens_do_not_shuffle(spark, monkeypatch):
    """But for inputs too small to reach all cores."""
    assert "RoundRobinPartitioning" in basic_token_rows(spark.range(3).select(F.col("id").alias("k"), F.lit("a").alias("text")), ["k"])._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(tables, "SPREAD_BYTES", 0)
    df = spark.createDataFrame([(1, "a")], "k int, text string")
    plan = basic_token_rows(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert "Exchange" not in E.encode(df, EDGE)._jdf.queryExecution().executedPlan().toString()
    assert df.select(F.lit(1)).count() == 1
