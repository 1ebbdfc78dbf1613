import random
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill import session
from glyphmill.functions.kernel import Config, RunTable, Tokenizer
from glyphmill.operators import encode as E
from glyphmill.operators import passes, wordpiece
from glyphmill.operators.basic import basic_token_rows
from glyphmill.plans import registry
from glyphmill.sources import tables
from glyphmill.sources.vocab import Vocab

from .test_tokenizer import ALPHABET, EDGE

LETTERS = [*ALPHABET, "the", "\0", "ﬁ", "ä", "Ǆ", "x" * 120]
CONFIGS = (Config(), Config(True, False), Config(False), Config(False, False), Config().with_specials(["the", "a9", "]["]), Config(stop_at_nul=False), Config(specials=()))


def texts(n, seed=3, most=40):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(LETTERS) for _ in range(rnd.randrange(most))) for _ in range(n)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small(spark, tmp_path, monkeypatch):
    """A folder of documents and benchmark, and inputs never dealt out."""
    monkeypatch.setattr(tables, "SPREAD_BYTES", 0)
    spark.createDataFrame(list(enumerate([*texts(50), None])), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("config", CONFIGS, ids=range(len(CONFIGS)))
def test_run_table(config):
    """Many texts at once are each text alone: pieces, ids, offsets, tokens."""
    tk = Tokenizer(EDGE, config)
    pieces, tokens, some = RunTable(tk, True), RunTable(tk, False), texts(400)
    assert all("".join(pieces.find(t)) == t for t in some)
    got, at = pieces.flat(some), 0
    for t, n in zip(some, got.per.tolist(), strict=True):
        own, offsets = tk.wordpiece(t)
        assert got.strings[at : at + n].to_pylist() == own and pieces.ids(got)[at : at + n].tolist() == tk.token_ids(own)
        assert [x for p in zip(got.start[at : at + n].tolist(), got.end[at : at + n].tolist(), strict=True) for x in p] == offsets
        at += n
    got, at = tokens.flat(some), 0
    for t, n in zip(some, got.per.tolist(), strict=True):
        assert list(zip(got.start[at : at + n].tolist(), got.end[at : at + n].tolist(), got.strings[at : at + n].to_pylist(), strict=True)) == tk.basic(t)
        at += n


def test_conversions_of_parts():
    """ids and tokens of whole parts, with nulls, slices and unknown tokens."""
    tk = Tokenizer(EDGE)
    column = pa.array([["x"], ["a", "??", None], None, [], ["b"]], pa.list_(pa.string())).slice(1)
    per, ids = E._framed(*E.ids_of(tk, column), 2, 3)
    assert per.tolist() == [5, 2, 2, 3] and ids.tolist() == [2, 13, 1, 1, 3, 2, 3, 2, 3, 2, 14, 3]
    per, back = E.tokens_of(tk, pa.array([[9], [13, 1], None, [14]], pa.list_(pa.int32())).slice(1))
    assert per.tolist() == [2, 0, 1] and back.to_pylist() == ["a", "[UNK]", "b"]
    for bad in (-1, len(EDGE)):
        with pytest.raises(IndexError):
            E.tokens_of(tk, pa.array([[bad]], pa.list_(pa.int32())))


@pytest.mark.parametrize("kind", ["text", "array"])
def test_parts_are_bounded(kind):
    """what a pass holds as Python objects is bounded by its bytes, not by its rows."""
    sizes = [random.Random(1).randrange(3000) for _ in range(3000)] + [500_000, 0, 1]
    column = pa.array(["x" * n for n in sizes] if kind == "text" else [[1] * n for n in sizes] + [None])
    found = list(passes.parts(iter([pa.RecordBatch.from_arrays([column], names=["c"])]), 0))
    assert pa.concat_arrays([p.column(0) for p in found]).equals(column)
    held = [sum(len(x or ()) for x in p.column(0).to_pylist()) for p in found]
    assert all(n <= passes.PART or p.num_rows == 1 for n, p in zip(held, found, strict=True)) and max(p.num_rows for p in found) <= 1000


@pytest.mark.parametrize("cls", [True, False])
def test_whole_encodings(spark, cls):
    """encodings that are not cut, whole parts at once."""
    some, tk = [*texts(300), None, "a b c " * 3000], Tokenizer(EDGE)
    df = spark.createDataFrame(list(enumerate(some)), "k int, text string")
    got = {r.k: r.input_ids for r in E.encode(df, EDGE, add_cls_sep=cls, truncation=False).collect()}
    assert all(got[k] == (None if t is None else tk.encode(t, cls, False)) for k, t in enumerate(some))
    for pad in (True, False):
        rows = E.encode_with_ids(df, EDGE, add_cls_sep=cls, padding=pad, truncation=False, max_length=16).collect()
        assert all(tuple(r[c] for c in E.ENCODING) == ((None,) * 4 if r.text is None else tk.encode_with_ids(r.text, cls, pad, False, 16)) for r in rows) and len(rows) == len(some)


@pytest.mark.parametrize("name", ["basic_token_byte_offsets", "special_token_split", "basic_token_offsets"])
def test_token_queries_are_one_pass(spark, small, name):
    """no array of offsets is summed up in column expressions, nothing is exploded or moved."""
    config = {"basic_token_byte_offsets": Config(True, False), "special_token_split": Config().with_specials("the"), "basic_token_offsets": Config()}[name]
    df = registry.queries()[name](spark, small)
    assert "MapInArrow" in plan(df) and "Generate" not in plan(df) and "Exchange" not in plan(df)
    want = basic_token_rows(spark.read.parquet(f"{small}/documents.parquet"), ["doc_id"], config=config)
    assert df.dtypes == want.dtypes and sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect()))


def test_piece_queries_are_one_pass(spark, small, monkeypatch):
    """F2, F8, F11: a piece is a row from the start; no join while the vocabulary is broadcast."""
    for name in ("wordpiece_offsets", "wordpiece_byte_offsets", "wordpiece_tokens"):
        found = plan(registry.queries()[name](spark, small))
        assert "MapInArrow" in found and not any(x in found for x in ("Generate", "Join", "Exchange"))
    df = spark.createDataFrame(list(enumerate(texts(200))), "k int, text string")
    fused = wordpiece.wordpiece_rows(df, ["k"], EDGE)
    monkeypatch.setattr(wordpiece, "MAX_BROADCAST_TOKENS", 5)
    joined = wordpiece.wordpiece_rows(df, ["k"], EDGE)
    assert "Join" in plan(joined) and fused.dtypes == joined.dtypes and sorted(map(tuple, fused.collect())) == sorted(map(tuple, joined.collect()))


def test_words_are_counted_where_they_are(spark):
    """words are counted within tasks, not exploded to rows."""
    some = [*texts(300), None]
    counts = passes.token_counts(spark.createDataFrame([(t,) for t in some], "text string").repartition(3))
    assert "Generate" not in plan(counts)
    tk = Tokenizer(EDGE)
    assert {r.token: r.n for r in counts.collect()} == Counter(x[2] for t in some if t is not None for x in tk.basic(t))


MANY = (*LETTERS, "­", "‍", "́", "a‍b", "한", "Ω", "ß", "İ", "中", "≠", "¿", " ", "\U0001F600", "\U00020000", "[SEP]", "[PAD][CLS]", "[SE", "P]", "\t", "\x7f", "The", "tHe", "x\0y")


def long_texts(n, seed, most=60):
    rnd = random.Random(seed)
    return [None if rnd.random() < 0.05 else "".join(chr(rnd.randrange(1, 0x3100)) if rnd.random() < 0.1 else rnd.choice(MANY) for _ in range(rnd.randrange(most))) for _ in range(n)]


@pytest.mark.parametrize("config", CONFIGS, ids=range(len(CONFIGS)))
def test_runs_of_whole_columns(config):
    """columns are cut into the runs that the regex finds text by text, slices and nulls too."""
    tk, some = Tokenizer(EDGE, config), long_texts(500, 5)
    table = RunTable(tk, False)
    for column in (pa.array(some, pa.string()), pa.array(some, pa.string()).slice(7, 300), pa.array(some, pa.large_string()), pa.array([], pa.string()), pa.array([None, "", "\0a"], pa.string())):
        found = table.cut(column)
        want = [[(m.start(), m[0]) for m in tk.match(tk.text(t or "")) if m.lastindex] for t in column.to_pylist()]
        assert found.per.tolist() == [len(x) for x in want] and found.strings.to_pylist() == [r for x in want for _, r in x]
        assert found.start(True).tolist() == [a for x in want for a, _ in x]


@pytest.mark.parametrize("config", CONFIGS, ids=range(len(CONFIGS)))
@pytest.mark.parametrize("seed", range(4))
def test_pieces_of_whole_columns(config, seed):
    """the trie's pieces are those of the walk word by word, for any vocabulary."""
    rnd, some = random.Random(seed), long_texts(300, seed)
    words = [x for t in some for _, _, x in Tokenizer(EDGE, config).basic(t or "") if x]
    cuts = [(w, a, a + rnd.randrange(1, 5)) for w in rnd.sample(words, min(len(words), 400)) for a in [rnd.randrange(len(w))]]
    tokens = ["[UNK]", "[PAD]", "##", "###", "####a", *(("##" if a else "") + w[a:b] for w, a, b in cuts), *(f"##{c}" for w in words[::3] for c in w), "x" * 101, "x" * 120, "x", "##" + "x" * 99]
    tk = Tokenizer(Vocab(tuple(tokens) if seed < 3 else ()), config)
    table = RunTable(tk, True)
    got, at = table.flat(some), 0
    for t, n in zip(some, got.per.tolist(), strict=True):
        own, offsets = tk.wordpiece(t or "")
        assert got.strings[at : at + n].to_pylist() == own and table.ids(got)[at : at + n].tolist() == tk.token_ids(own)
        assert [x for p in zip(got.start[at : at + n].tolist(), got.end[at : at + n].tolist(), strict=True) for x in p] == offsets
        at += n


def test_distinct_words_are_not_walked_one_by_one(monkeypatch):
    """most of a corpus' distinct words are rare, so each of them may cost no Python call."""
    seen = []
    monkeypatch.setattr(Tokenizer, "run_pieces", lambda self, run, kind, f=Tokenizer.run_pieces: seen.append(run) or f(self, run, kind))
    tk = Tokenizer(EDGE)
    column = pa.array([" ".join(f"Wörd{i}, a{i}" for i in range(k, k + 100)) for k in range(0, 5000, 100)])
    got = RunTable(tk, True).flat(column.to_pylist())
    assert not seen
    assert got.per.tolist() == [len(tk.wordpiece(t)[0]) for t in column.to_pylist()]


def test_tasks_do_not_grow_with_the_input(spark, tmp_path, monkeypatch):
    """a task's share of the files is bounded; the files' size counts, not an estimate for a column."""
    path, cores = str(tmp_path / "t.parquet"), spark.sparkContext.defaultParallelism
    rows = spark.range(4000).select("id", *(F.lit(None).cast("string").alias(f"c{k}") for k in range(9)), F.concat_ws(" ", *(F.rand(k) for k in range(9))).alias("text"))
    rows.coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    monkeypatch.setattr(tables, "SPREAD_BYTES", size)
    monkeypatch.setattr(tables, "TASK_BYTES", size // (5 * cores), raising=False)
    assert tables.spread(df).rdd.getNumPartitions() >= 5 * cores
    monkeypatch.setattr(tables, "SPREAD_BYTES", size // (2 * cores))
    assert "Exchange" not in plan(tables.spread(df.select("text")))


def test_splits_are_small_unless_set(spark):
    """a scan's tasks are bounded where the session does not say otherwise."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        for given, want in ((None, "32m"), ("64m", "64m")):
            spark.conf.set(key, given) if given else spark.conf.unset(key)
            assert session.ship(spark).conf.get(key) == want
    finally:
        spark.conf.set(key, before)


def test_padding_holds_no_more_than_it_gives(spark, monkeypatch):
    """encodings are filled where they are cut, not made longer by all zeros first."""
    got = []
    monkeypatch.setattr(E, "_mapped", lambda df, column, vocab, config, outs, of: got.append(of))
    E.encode_with_ids(None, EDGE, truncation=False, max_length=500)
    tk, column = Tokenizer(EDGE), pa.array(["a b c", None, "", "a " * 600] * 250)
    got[0](tk, column)
    tracemalloc.start()
    try:
        ids = got[0](tk, column)[0]
        kept, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert ids[0].tolist() == [500] * 1000 and ids[1][:6].tolist() == [*tk.encode("a b c"), 0] and ids[1][-1] == tk.token_ids(["a"])[0]
    assert peak < 22_000_000, (kept, peak)
