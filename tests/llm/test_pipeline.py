"""The pipeline against a brute-force version of its stages."""

import base64
import hashlib
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glyphmill.llm import decontaminate, language_id
from glyphmill.llm.queries import tokenizer_file

from .conftest import DOCS, words
from .test_tables import brute_components, distance_within


def test_pipeline(spark, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    rng = random.Random(9)
    items = [words(rng, 25) for _ in range(5)]
    texts = [words(rng, rng.randint(5, 120)) for _ in range(60)]
    texts += [texts[0], texts[1].replace(" ", "\n"), texts[2] + " w1", items[0], f"{texts[3]} {items[1].upper()} {texts[4]}", None, "123", ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    model = language_id.train(docs)
    langs, scores = language_id.predict(model, [t for t in texts])
    left = [(i, t) for i, t in enumerate(texts) if langs[i] != "und" and scores[i] >= language_id.REJECTED]
    seen, once = set(), []
    for i, t in left:
        if (n := re.sub(r"[\x20\x09-\x0D]+", " ", t)) not in seen:
            seen.add(n)
            once.append((i, t))
    near = brute_components(once)
    apart = [(i, t) for i, t in once if near[i][1] == i]
    limit = lambda n: min(int(len(n) * decontaminate.EDITS), (len(n) - decontaminate.Q) // decontaminate.Q)
    clean = [(i, t) for i, t in apart if not any(distance_within(n := decontaminate.normalised(x), decontaminate.normalised(t)) <= limit(n) for x in items)]
    path, pattern = tokenizer_file()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    want = {}
    for i, t in clean:
        ids = enc.encode_ordinary(t)
        want[i] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert got == want and 50 < len(want) < len(texts) - 6
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "decontaminate", "bpe"]


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Empty tables, repeated rows and ids, clashing columns."""
    rng = random.Random(4)
    text, other = words(rng, 40), words(rng, 3000)
    rows = [(1, text), (1, text), (2, text + " w1"), (3, other), (3, None), (None, words(rng, 30)), (4, ""), (5, "12 34")]
    columns = ("uid", "tag", "digit", "n", "path", "label", "c0", "ids", "decoded", "item_id", "score", "_id", "_sha")
    for name, docs, items in (("all", rows, [(0, words(rng, 20))]), ("none", [], [(0, "x")]), ("bare", rows, [])):
        df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], DOCS).withColumns({c: F.lit("x") for c in columns})
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        kept = sorted((r.doc_id or -1, r.decoded_sha256) for r in got)
        assert kept == (sorted([(1, digest(text)), (1, digest(text)), (3, digest(other)), (-1, digest(rows[5][1]))]) if docs else [])
