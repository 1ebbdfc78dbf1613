"""Operators that look at many rows."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import chat_format, decontaminate, exact_dedup, ngram_join, sharding
from glyphmill.llm.components import components

from .conftest import words

# ------------------------------------------------------------------------------------------- copies


def test_exact_dedup(spark, frame, rng):
    long = words(rng, 30_000)
    texts = [long, long + " x", long, "a  b", "a\tb", "a b ", None, "", " ", "\n", "A b"] + [long[:70] + str(i % 3) for i in range(12)] + ["x" * 64, "x" * 65, "x" * 64]
    ids = [*range(1, len(texts) + 1)]
    want = collections.defaultdict(list)
    for i, t in zip(ids, texts, strict=True):
        want[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    by = {i: (min(g), len(g), min(g) == i, hashlib.sha256(t.encode()).hexdigest()) for t, g in want.items() for i in g}
    rows = exact_dedup.exact_dedup(frame(texts, ids)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == by and len(rows) == len(texts)
    kept = exact_dedup.drop_copies(frame(texts, ids))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in want.values()) and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_exact_dedup_digit_by_digit(spark, frame, rng, monkeypatch):
    """Groups that part at any digit, end at a digit's end, or are longer than all widths; with and without broadcast."""
    alphabet = "ab "
    for widths, limit in (((2, 3, 4, 5), 10**6), ((3, 4), 0), ((64, 256, 1024), 0)):
        monkeypatch.setattr(exact_dedup, "WIDTHS", widths)
        monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", limit)
        stem = "".join(rng.choice(alphabet) for _ in range(5000))
        texts = [stem[: rng.choice([0, 1, 2, 3, 5, 9, 14, 15] if widths[0] < 64 else [2, 64, 320, 1344])] + rng.choice(["", "", "a", "b"]) for _ in range(120)] + [None, ""]
        texts += [stem, stem, stem + "a"] if widths[0] == 64 else []
        ids = [rng.randrange(80) for _ in texts]
        groups = collections.defaultdict(list)
        for i, t in zip(ids, texts, strict=True):
            groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
        want = sorted((i, min(g), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
        clash = frame(texts, ids).withColumns({c: F.lit("x") for c in ("uid", "tag", "digit", "gid", "_id", "_sha", "keep", "n")})
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_dedup(clash).collect()) == want
        kept = exact_dedup.drop_copies(clash)
        assert kept.columns == clash.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for t, g in groups.items() for i in g if i == min(g))


def test_exact_dedup_of_odd_ids(spark, frame):
    rows = exact_dedup.exact_dedup(frame(["a", "a", "a", "b", "c", "c"], [5, 5, None, 5, None, None])).collect()
    got = sorted(((r.doc_id or -1), (r.keep_id or -1), r.group_size, r.kept) for r in rows)
    assert got == [(-1, -1, 2, True), (-1, -1, 2, True), (-1, 5, 3, False), (5, 5, 1, True), (5, 5, 3, True), (5, 5, 3, True)]
    assert exact_dedup.exact_dedup(frame([])).count() == 0


# ---------------------------------------------------------------------------------------- benchmark


def distance_within(item, text):
    """Least edits between item and any part of text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i in range(1, len(item) + 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (item[i - 1] != c)))
        row, best = new, min(best, new[-1])
    return best


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        p, how = rng.randrange(len(s)), rng.randrange(3)
        if how == 0:
            s[p] = rng.choice("xyz ")
        elif how == 1:
            s.insert(p, rng.choice("xyz"))
        else:
            del s[p]
    return "".join(s)


def test_decontaminate(spark, frame, rng):
    items = [(i, words(rng, rng.randint(9, 40), 90)) for i in range(15)] + [(99, "too short"), (98, None), (97, "")]
    docs = [None, "", "short", items[0][1].upper(), "\n ".join(items[1][1].split(" "))]
    for _ in range(45):
        parts = [words(rng, rng.randrange(50), 90)]
        for _ in range(rng.randrange(3)):
            it = rng.choice(items[:15])[1]
            parts += [edited(rng, it, rng.randrange(int(len(it) * 0.13) + 1)), words(rng, rng.randrange(10), 90)]
        docs.append(" ".join(parts))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find_leaks(frame(docs), bench).collect()}
    want = {}
    for d, text in enumerate(docs):
        for i, it in items[:15]:
            n = decontaminate.normalised(it)
            if text and (e := distance_within(n, decontaminate.normalised(text))) <= min(int(len(n) * decontaminate.EDITS), (len(n) - decontaminate.Q) // decontaminate.Q):
                want[d, i] = e
    assert got == want and len(want) > 15 and (3, 0) in got and (4, 1) in got
    clean = {r.doc_id for r in decontaminate.drop_leaks(frame(docs), bench).collect()}
    assert clean == set(range(len(docs))) - {d for d, _ in want}
    assert decontaminate.find_leaks(frame([]), bench).count() == 0 and decontaminate.find_leaks(frame(docs), bench.limit(0)).count() == 0


def test_decontaminate_in_blocks(spark, frame, rng, monkeypatch):
    items = [(i, words(rng, 20)) for i in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 500)
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame([t for _, t in items]), bench).collect()}
    assert got == {(i, i) for i in range(30)}
    assert decontaminate.drop_leaks(frame([t for _, t in items] + ["a clean one"]), bench).count() == 1


def test_decontaminate_common_grams(spark, frame, rng, monkeypatch):
    """Items that share phrases lose nothing when common q-grams are left out, in one pass or several; ids of any type."""
    stem = words(rng, 8)
    items = [(f"i{k}", f"{stem} {words(rng, 6)} {stem}" if k % 2 else f"{words(rng, 12)} {stem}") for k in range(24)] + [("same", stem), (None, words(rng, 9))]
    docs = [f"{words(rng, 5)} {edited(rng, t, rng.randrange(8))} {words(rng, 9)}" for _, t in items for _ in range(2)] + [stem, words(rng, 3000), None]
    want = {}
    for d, text in enumerate(docs[:-2]):
        for i, it in items:
            n = decontaminate.normalised(it)
            if (e := distance_within(n, decontaminate.normalised(text))) <= min(int(len(n) * decontaminate.EDITS), (len(n) - decontaminate.Q) // decontaminate.Q):
                want[d, i] = e
    bench = spark.createDataFrame(items, "item_id string, text string")
    for common, left, chars, per_pass in ((256, 0.5, 10**6, 8), (2, 0.0, 10**6, 8), (1, 0.2, 400, 2)):
        for k, v in (("COMMON", common), ("LEFT", left), ("BLOCK_CHARS", chars), ("PASS_BLOCKS", per_pass)):
            monkeypatch.setattr(decontaminate, k, v)
        clash = frame(docs).withColumns({c: F.lit("x") for c in ("item_id", "times", "edits", "start", "time")})
        got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find_leaks(clash, bench).collect()}
        assert {k: v for k, v in got.items() if k[0] < len(docs) - 2} == want and len(want) > 24
        kept = decontaminate.drop_leaks(clash, bench)
        assert kept.columns == clash.columns and {r.doc_id for r in kept.collect()} == set(range(len(docs))) - {d for d, _ in got}
    twice = frame([docs[0], docs[0]], [None, None])
    assert [r.doc_id for r in decontaminate.find_leaks(twice, bench).where("item_id = 'i0'").collect()] in ([None, None], [])


def test_decontaminate_short_items(spark, frame, rng):
    """Items of any length are found; those too short for an edit as whole words."""
    items = [(0, "Who wrote Pride and Prejudice?"), (1, "Who was first?"), (2, "cat"), (3, "首都是北京"), (4, "to be"), (5, "who was first?"), (6, " ")]
    docs = ["q: who  wrote pride and prejudice? austen", "who wrote pride und prejudice?", "Who WAS\nfirst? me", "who was first", "concat cats", "a cat.", "中国的首都是北京吗", "into be", "to be", None, "x" * 50]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.edits, r.start, r.end) for r in decontaminate.find_leaks(frame(docs), bench).collect()}
    edits = {k: v[0] for k, v in got.items()}
    assert edits == {(0, 0): 0, (1, 0): 1, (2, 1): 0, (2, 5): 0, (5, 2): 0, (6, 3): 0, (8, 4): 0} and got[5, 2] == (0, 2, 5) and got[6, 3] == (0, 3, 8)
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(frame(docs), bench).collect()) == [3, 4, 7, 9, 10]
    assert {r.item_id for r in decontaminate.find_leaks(frame(docs), bench, min_chars=14).collect()} == {0, 1, 5}


def test_decontaminate_repeated_items(spark, frame, rng, monkeypatch):
    """A row that the benchmark repeats is indexed once and reported as often."""
    text, other = words(rng, 12), words(rng, 12)
    bench = spark.createDataFrame([(1, text)] * 40 + [(2, text), (None, other), (None, other), (3, "cat"), (3, "cat")], "item_id long, text string")
    assert sorted(len(b) for b in decontaminate.blocks(bench, "item_id", "text")) == [4]
    got = collections.Counter((r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame([text, other, "a cat", "none"]), bench).collect())
    assert got == {(0, 1): 40, (0, 2): 1, (1, None): 2, (2, 3): 2}
    assert [r.doc_id for r in decontaminate.drop_leaks(frame([text, other, "a cat", "none"]), bench).collect()] == [3]
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    assert sum(len(b) for b in decontaminate.blocks(bench, "item_id", "text")) == 4 and len(list(decontaminate.blocks(bench, "item_id", "text"))) == 2


# --------------------------------------------------------------------------------------------- join


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))
        sets[i] = frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, o in sets.items():
            if j < i and s and o and 100 * len(s & o) >= 85 * len(s | o):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def families(rng):
    passages = [words(rng, 30) for _ in range(5)]
    docs = []
    for _ in range(45):
        base = words(rng, rng.choice([3, 5, 8, 20, 60, 200])).split()
        if rng.random() < 0.5:
            base += f"{rng.choice(passages)} {rng.choice(passages)}".split()
        for _ in range(rng.choice([1, 1, 2, 5, 20])):
            d = list(base)
            for _ in range(rng.randrange(len(d) // 25 + 2)):
                d[rng.randrange(len(d))] = f"w{rng.randrange(400)}"
            docs.append((" " if rng.random() < 0.5 else "\n\t").join(d) if rng.random() < 0.9 else " ".join(d).upper())
    docs += [None, "", "  ", "one", "one", "One two", "one two", "é É", "É é"]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed,seeds,family,block", [(1, 4, 1, 2048), (2, 1, 4, 8), (3, 0, 16, 16)])
def test_ngram_join(spark, frame, monkeypatch, seed, seeds, family, block):
    monkeypatch.setattr(ngram_join, "FAMILY", family)
    monkeypatch.setattr(ngram_join, "SEEDS", seeds)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    docs = families(random.Random(seed))
    rows = ngram_join.jaccard_components(frame(docs)).collect()
    want = brute_components(list(enumerate(docs)))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want and len(rows) == len(docs)
    kept = ngram_join.keep_one(frame(docs))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()}) and kept.columns[:2] == ["doc_id", "text"]


def test_ngram_join_of_odd_rows(spark, frame):
    text = "a b c d e f g h"
    rows = ngram_join.jaccard_components(frame([text, text, text, "z y x w", text], [4, 4, None, 4, 9])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in rows) == [(-1, 5, -1), (4, 1, 4), (4, 5, 4), (4, 5, 4), (9, 5, 4)]
    assert ngram_join.jaccard_components(frame([])).count() == 0
    rng = random.Random(8)
    long = words(rng, 40_000, 10**6)
    clash = frame([long, long + " x", None, "", long], [7, 8, 9, 10, 7]).withColumns({c: F.lit("x") for c in ("n", "path", "comp", "_id", "label", "node", "need", "c0")})
    rows = ngram_join.jaccard_components(clash).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(7, 7), (7, 7), (8, 7), (9, 9), (10, 10)] and max(r.n_shingles for r in rows) > 39_000
    kept = ngram_join.keep_one(clash)
    assert kept.columns == clash.columns and sorted(r.doc_id for r in kept.collect()) == [7, 7, 9, 10]


def test_tree_pairs_cover_all_links(rng):
    """On any sets, the trees of all shared prefix elements together hold every pair that links."""
    sets = [sorted(rng.sample(range(60), rng.randint(5, 30))) for _ in range(25)]
    sets += [sorted(set(s) - {rng.choice(s)}) for s in sets for _ in range(2)]
    found = set()
    for e in range(60):
        docs, where = [], []
        for k, s in enumerate(sets):
            cut = s[: len(s) - ngram_join.least_overlap(len(s)) + 1]
            if e in cut:
                at = cut.index(e)
                docs.append((k, k, len(s), len(s) - at - 1, cut[at + 1 :]))
                where.append(k)
        found |= {(where[a], where[b]) for a, b in ngram_join.tree_pairs(docs)}
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            x, y = set(sets[a]), set(sets[b])
            if 100 * len(x & y) >= 85 * len(x | y):
                assert (a, b) in found


def test_tree_pairs_between_blocks(rng):
    """Block against block, trees hold every pair that links, whichever of the two sets is larger."""
    common = list(range(100, 188))
    sets = [[*range(12), *common], [12, 13, *common]]
    for own in range(20):
        base = rng.sample(range(200, 260), 40)
        sets += [sorted([*base[: 40 - cut], *range(1000 + 50 * own + 10 * cut, 1000 + 50 * own + 10 * cut + more)]) for cut, more in ((0, 0), (0, 5), (2, 3), (3, 0))]
    need = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * len({*sets[a]} & {*sets[b]}) >= 85 * len({*sets[a]} | {*sets[b]})}
    for turn in (0, 1):
        found = set()
        for e in sorted({e for s in sets for e in s}):
            docs, where = [], []
            for k, s in enumerate(sets):
                cut = s[: len(s) - ngram_join.least_overlap(len(s)) + 1]
                if e in cut:
                    at = cut.index(e)
                    docs.append((k, k, len(s), len(s) - at - 1, cut[at + 1 :]))
                    where.append(k)
            block = [(k + turn) % 2 for k in where]
            for i, j in ((0, 0), (0, 1), (1, 1)):
                pairs = ngram_join.tree_pairs(docs, blocks=(block, i, j))
                assert all({block[a], block[b]} == {i, j} for a, b in pairs)
                found |= {(where[a], where[b]) for a, b in pairs}
        assert (0, 1) in need <= found


def test_components(spark, rng):
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, 500)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}


# ----------------------------------------------------------------------------------------- sharding


def brute_table(shards, size):
    owner, orders = [None] * size, []
    for s in shards:
        offset, skip = sharding.preference(s, size)
        orders.append(iter([(offset + j * skip) % size for j in range(size)]))
    left = size
    while left:
        for s, order in zip(shards, orders, strict=True):
            if left:
                slot = next(x for x in order if owner[x] is None)
                owner[slot] = s
                left -= 1
    return owner


def test_sharding(spark, frame):
    shards = [f"s{i}" for i in range(7)]
    table = [shards[i] for i in sharding.lookup_table(shards, 499)]
    assert table == brute_table(shards, 499)
    sizes = collections.Counter(table)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    fewer = [shards[i] for i in sharding.lookup_table(shards[:-1], 499)]
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != "s6") < 0.15 * 499
    weighted = collections.Counter(sharding.lookup_table(["a", "b"], 499, {"a": 3}))
    assert 2.8 < weighted[0] / weighted[1] < 3.2
    texts = ["k"] * 50 + [None, ""]
    got = sharding.place(frame(texts).withColumn("slot", F.lit("clash")), "doc_id", shards, 499).collect()
    for r in got:
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:8], 16) % 499
        assert (r.slot, r.shard) == (slot, table[slot])
    assert sharding.place(frame(texts), "text", shards, 499).select("shard").distinct().count() <= 3
    assert {r.slot for r in sharding.place(frame([None], [None]), "doc_id", shards, 499).collect()} == {0}
    assert sharding.place(frame([]), "doc_id", shards, 499).count() == 0
    long = sharding.place(frame(["x" * 1_000_000, "x" * 1_000_000]), "text", shards, 499).collect()
    assert {r.slot for r in long} == {int(hashlib.md5(b"x" * 1_000_000).hexdigest()[:8], 16) % 499}
    for bad in ((["a", "a"], 499), ([], 499), (["a"], 500)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


# --------------------------------------------------------------------------------------------- chat


def test_chat(spark, rng):
    bits = ["</s>", "[INST]", "[/INST]", " [/INST]", "<s> ", "\\", "\\</s>", " </s>", "[ROLE:41] ", " [/ROLE]", "ok", " ", "\n", "é", "[", "]", "<", "[INST[INST]"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "we\nird </s>", None]), rng.choice(["".join(rng.choice(bits) for _ in range(rng.randrange(9))), None])) for c in range(120) for t in range(rng.randrange(1, 7))]
    rows += [(500, None, "user", "first"), (500, 1, "user", "b"), (500, 1, "user", "b"), (500, 1, "assistant", "a"), (None, 0, "user", "x" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1))
    made = chat_format.format_conversations(df)
    told = collections.defaultdict(list)
    for c, t, role, text in rows:
        told[c].append((t is not None, t or 0, role or "", text or ""))
    for r in made.collect():
        assert r.exact and [tuple(x) for x in r.turns] == [x[2:] for x in sorted(told[r.conv_id])]
    digests = {r.conv_id: r for r in chat_format.digests(made).collect()}
    for c, turns in told.items():
        turns = [x[2:] for x in sorted(turns)]
        said = "".join(t for role, t in turns if role == "assistant")
        assert digests[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (digests[c].n_turns, digests[c].loss_chars, digests[c].loss_sha256) == (len(turns), len(said), hashlib.sha256(said.encode()).hexdigest())
    plain = [r for r in made.collect() if r.escape_level == 0]
    assert plain and chat_format.format_conversations(df.limit(0)).count() == 0
