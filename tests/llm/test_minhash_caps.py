import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import caps, common, minhash


def classes(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("kind", ["unit", "counts", "real"])
def test_darts_estimate_weighted_jaccard(kind):
    draw = np.random.default_rng(3)
    make = {"unit": lambda: np.ones(60), "counts": lambda: draw.integers(1, 9, 60).astype(float), "real": lambda: draw.gamma(1.0, 0.7, 60)}[kind]
    a, b = make(), make()
    a[:10], b[-20:] = 0, 0
    elements = draw.integers(0, 1 << 62, 60).astype(np.uint64)
    rows = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
    signs = minhash.dart_signatures(rows, np.concatenate([elements[a > 0], elements[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 3, 8000)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((signs[0] == signs[1]).mean() - true) < 0.025
    assert (signs[2] == np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_signature_does_not_depend_on_company():
    draw = np.random.default_rng(4)
    e, w = draw.integers(0, 1 << 62, 500).astype(np.uint64), draw.integers(1, 4, 500).astype(float)
    alone = minhash.dart_signatures(np.zeros(500, int), e, w, 1, 64)
    among = minhash.dart_signatures(np.concatenate([np.zeros(3, int), np.ones(500, int)]), np.concatenate([e[:3], e]), np.concatenate([w[:3], w]), 2, 64)
    assert (alone[0] == among[1]).all()


def test_shingles():
    rows, _, counts = minhash.Shingles(5).sets(pa.array([None, "", " a ", "A  b", "a b c d e", "a b c d e a b c d e\n"]))
    assert rows.tolist() == [2, 3, 4, 5, 5, 5, 5, 5] and sorted(counts.tolist()) == [1] * 7 + [2]


def make_texts():
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefgh", k=5))
    base, texts = [[word() for _ in range(draw.randint(6, 120))] for _ in range(60)], [None, None, "", " ", "one two", "one two", "Two one"]
    for words in base:
        texts.append(" ".join(words))
        for _ in range(draw.randint(0, 6)):
            near = list(words)
            for _ in range(draw.randint(0, max(1, len(words) // 25))):
                near[draw.randrange(len(near))] = word()
            texts.append(" ".join(near))
    chain = [word() for _ in range(200)]  # each like the next, the ends unlike
    for k in range(12):
        texts.append(" ".join(chain[:200] if k == 0 else [*(word() for _ in range(4)), *chain[4:]]))
        chain = texts[-1].split()
        chain = chain[4:] + chain[:4]
    texts += [" ".join([*(word() for _ in range(40)), *["and so"] * 300]) for _ in range(30)]  # much alike only by one pair of words
    texts += ["copied text of seven words or so"] * 300 + ["x " * 30_000, "x " * 30_000 + "y"]
    return texts


def similarity_links(texts, weigh):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []))
    weight = {"set": lambda n: 1, "count": lambda n: n, "log": int.bit_length}[weigh]
    sets = [Counter({g: weight(n) for g, n in s.items()}) for s in sets]
    where = defaultdict(set)
    for i, s in enumerate(sets):
        for g in s:
            where[g].add(i)
    pairs = {(a, b) for x in where.values() for a in x for b in x if a < b}
    for a, b in pairs:
        both = sum((sets[a] & sets[b]).values())
        if both >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - both):
            yield a, b


@pytest.mark.parametrize("rounds, weigh, chunk, ids", [(0, "set", 3, 1), (4, "log", 1024, 10**6), (1, "count", 1024, 10**6), (0, "count", 3, 10**6), (1, "log", 512, 1)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, rounds, weigh, chunk, ids):
    monkeypatch.setattr(minhash, "HUB_ROUNDS", rounds)
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    monkeypatch.setattr(minhash, "HUB_MEMBERS", chunk)
    monkeypatch.setattr(common, "BROADCAST_BYTES", ids)
    monkeypatch.setattr(common, "LOCAL_LINKS", ids)
    texts = make_texts()
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], "doc_id long, text string, class_id string, id int").repartition(5)
    got = {r.doc_id: r for r in minhash.near_duplicates(df, weigh=weigh).collect()}
    want = classes(range(len(texts)), similarity_links(texts, weigh))
    assert {i: r.class_id for i, r in got.items()} == want
    assert all(r.kept == (r.class_id == i) for i, r in got.items())


def test_weights():
    counts = np.array([1, 2, 3, 4, 7, 8, 298, 1 << 40])
    assert minhash.weights_of(counts, "log").tolist() == [int(c).bit_length() for c in counts]
    assert minhash.weights_of(counts, "count").tolist() == counts.tolist() and set(minhash.weights_of(counts, "set")) == {1}
    with pytest.raises(ValueError):
        minhash.weights_of(counts, "idf")


def test_weights_decide(spark):
    """Two texts with the same shingles, of which one repeats a line: alike as sets, not by weights."""
    line = " ".join(f"a{i}" for i in range(9))
    texts = [line, "\n".join([line] * 40), "\n".join([line] * 41)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {w: [r.class_id for r in minhash.near_duplicates(df, shingle=2, weigh=w).orderBy("doc_id").collect()] for w in ("log", "count", "set")}
    assert found["log"] == [0, 1, 1] and found["count"] == [0, 1, 1]
    plain = minhash.Shingles(5).sets(pa.array(texts))
    assert len(set(minhash.weights_of(plain[2], "log"))) > 1


def test_finer_buckets_keep_all_similar_pairs(spark):
    draw = np.random.default_rng(3)
    sets = {}
    for i in range(0, 120, 3):
        base = [int(x) for x in draw.integers(0, 1 << 40, draw.integers(1, 60))]
        for j in range(3):
            own = list(base)
            for _ in range(draw.integers(0, 1 + len(own) // 9)):
                own[draw.integers(len(own))] = int(draw.integers(0, 1 << 40))
            sets[i + j] = sorted({*own, 1, 2, 3})
    rows = spark.createDataFrame([(i, len(s), s) for i, s in sets.items()], "id long, n int, elements array<bigint>")
    apart = spark.createDataFrame([(7, i, i) for i in sets], "key long, id long, root long")
    where = defaultdict(set)
    for r in minhash.finer(apart, rows, 0.8).collect():
        where[r.key].add(r.id)
    met = {(a, b) for x in where.values() for a in x for b in x if a < b}
    alike = {(a, b) for a in sets for b in sets if a < b and len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})}
    assert alike and alike <= met and len(met) < 1000


def test_repeated_and_null_ids(spark):
    long = "a b c d e f g h i j"
    df = spark.createDataFrame([(1, long), (1, long), (2, long), (None, long), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.class_id or -1, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [(-1, -1, True), (-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("local", [200_000, 0])
def test_connect(spark, monkeypatch, local):
    monkeypatch.setattr(common, "LOCAL_LINKS", local)
    draw = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(40)] + [(draw.randint(300, 500), draw.randint(300, 500)) for _ in range(120)] + [(7, 7)]
    real = [p for p in links if p[0] != p[1]]
    want = classes({x for p in real for x in p}, real)
    assert {r.id: r.root for r in common.connect(spark.createDataFrame(links, "a long, b long"), "t").collect()} == want
    assert common.connect(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def make_vectors():
    draw = np.random.default_rng(9)
    rows = []
    for label in (0, 1, None):
        for _ in range(40):
            x = draw.standard_normal(16)
            rows += [(label, (x + draw.standard_normal(16) * s).tolist()) for s in (0, 0, 0.02, 0.1, 0.3)]
    rows += [(1, [float("nan")] * 16), (1, [0.0] * 16), (1, None), (1, []), (1, [None] * 16), (1, [float("inf")] + [1.0] * 15), (0, [1.0, 2.0]), (0, [2.0, 4.0]), (0, [1e-300] * 16), (0, [1e300] * 16)]
    return rows


@pytest.mark.parametrize("chunk, large", [(1024, 24), (3, 24), (1024, 2), (3, 2)])
def test_caps_equal_brute_force(spark, monkeypatch, chunk, large):
    monkeypatch.setattr(caps, "CHUNK", chunk)
    monkeypatch.setattr(caps, "LARGE", large)
    rows = make_vectors()
    df = spark.createDataFrame([(i, v, l, 5) for i, (l, v) in enumerate(rows)], "vec_id long, embedding array<double>, label int, n_links int").repartition(3)
    links = []
    good = lambda v: v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v)
    for i, (l, v) in enumerate(rows):
        for j in range(i):
            m, w = rows[j]
            if l is not None and l == m and good(v) and good(w) and len(v) == len(w):
                x, y = (np.array(z) / np.abs(z).max() for z in (v, w))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links.append((j, i))
    n = Counter(x for p in links for x in p)
    want = classes(range(len(rows)), links)
    for r in caps.near_duplicates(df).collect():
        assert (r.n_links, r.component_id, r.kept) == (n[r.vec_id], want[r.vec_id], want[r.vec_id] == r.vec_id)


def test_recall_at_the_threshold():
    draw = np.random.default_rng(2)
    x, y = draw.standard_normal((2, 1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    for most in (10, 2000, 50_000):
        code = caps.choose(32, most, 0.93)
        met = [set(zip(*map(np.ndarray.tolist, code.decode(z)), strict=True)) for z in (x, y)]
        assert len({r for r, _ in met[0] & met[1]}) >= 0.985 * len(x)


def test_caps_empty(spark):
    df = spark.createDataFrame([(1, [0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert caps.near_duplicates(df).collect()[0].kept and caps.near_duplicates(df.limit(0)).count() == 0
