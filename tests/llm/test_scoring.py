import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import attention, scoring
from palimpsest.llm.attention import DENSE, END, LENGTH, RARE, RARE_FIRST

RANKS = P.path("byte_bpe_50k.tiktoken")


def held():
    return F.expr("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def toy_model():
    draw = np.random.default_rng(1)
    first = np.arange(scoring.RAW_IDS) % 3 == 0
    often = draw.integers(0, 50, scoring.RAW_IDS)
    dense, rare, begins = scoring.dense_ids(often, first)
    classes, prior, member = attention.counted(draw.integers(0, 4, (DENSE, DENSE)).astype(float), begins)
    samples = draw.integers(0, DENSE, (300, LENGTH + 1))
    weights = attention.fit(samples, classes, prior, attention.begun(), passes=2)
    return attention.Model(dense, rare, begins, classes, prior.astype(np.float32), member.astype(np.float32), weights), first


def test_next_ids_sum_up_to_one():
    model, first = toy_model()
    ids = np.random.default_rng(2).integers(0, DENSE, (1, LENGTH))
    place = 20
    total = {True: 0.0, False: 0.0}
    edges = {}
    for k in range(DENSE):
        then = ids.copy()
        then[0, place] = k
        own, edge = (x[0, place] for x in model.score(ids, then))
        total[bool(model.begins[k])] += float(np.exp(np.float64(own)))
        edges[bool(model.begins[k])] = float(edge)
    begins = np.exp(edges[True])
    assert abs(total[True] - 1) < 1e-4 and abs(total[False] + begins - 1) < 1e-4
    for shared, own in ((RARE, ~first), (RARE_FIRST, first)):
        assert abs(np.exp(model.rare[(model.dense == shared) & own]).sum() - 1) < 1e-9


def test_causal_and_each_id_once():
    model, first = toy_model()
    draw = np.random.default_rng(3)
    begin, go_on = np.flatnonzero(first), np.flatnonzero(~first)
    text = lambda n: np.concatenate([[draw.choice(begin)], *([draw.choice(begin)] if draw.random() < 0.4 else [draw.choice(go_on)] for _ in range(n - 1))]) if n else np.zeros(0, int)
    texts = [text(n) for n in (0, 1, 31, 32, 33, 55, 56, 57, 200, 0)]
    got = model.score_words(np.concatenate(texts), np.array([len(t) for t in texts]))
    at = 0
    for t in texts:  # one window for each id, without batches
        ids, then = np.concatenate([[END], model.dense[t]]).astype(int), np.concatenate([model.dense[t], [END]]).astype(int)
        want, shares = [], np.append(model.rare[t], 0)
        for i in range(len(ids)):
            start = 0 if i < LENGTH else LENGTH - attention.STRIDE + (i - LENGTH) // attention.STRIDE * attention.STRIDE + attention.STRIDE - (LENGTH - attention.STRIDE)
            window, follow = np.full((1, LENGTH), END), np.full((1, LENGTH), END)
            window[0, : min(LENGTH, len(ids) - start)], follow[0, : min(LENGTH, len(ids) - start)] = ids[start : start + LENGTH], then[start : start + LENGTH]
            window[0, i - start + 1 :] = 5  # what comes later doesn't matter
            own, edge = (x[0, i - start] for x in model.score(window, follow))
            if model.begins[then[i]]:
                if want:
                    want[-1] += edge
                want.append(own + shares[i])
            else:
                want[-1] += own + shares[i]
        assert np.allclose(got[at : at + len(want)], want, atol=1e-3)
        at += len(want)
    assert at == len(got)


def test_gradients():
    draw = np.random.default_rng(5)
    samples = np.tile(draw.integers(0, 40, LENGTH + 1), (400, 1))  # one window again and again can be learnt
    pairs = np.ones((DENSE, DENSE))
    begins = np.arange(DENSE) % 2 == 0
    classes, prior, member = attention.counted(pairs, begins)
    weights = attention.fit(samples, classes, prior, attention.begun(), passes=100, rate=6e-3)
    model = attention.Model(np.arange(DENSE), np.zeros(DENSE), begins, classes, prior.astype(np.float32), np.zeros((DENSE, DENSE), np.float32), weights)
    own, edge = model.score(samples[:1, :-1], samples[:1, 1:])
    assert np.exp((own + edge).mean()) > 0.8


def test_gradients_are_those_of_the_loss():
    """Each weight's step against differences of the plain model's loss."""
    draw = np.random.default_rng(6)
    samples, begins = draw.integers(0, 30, (4, LENGTH + 1)), np.arange(DENSE) % 2 == 0
    classes, prior, _ = attention.counted(draw.integers(0, 9, (DENSE, DENSE)).astype(float), begins)
    start = {k: v if k in ("ids", "places") else (draw.standard_normal(v.shape) * 0.3).astype(np.float32) for k, v in attention.begun().items()}

    def loss(w):
        model = attention.Model(np.arange(DENSE), np.zeros(DENSE), begins, classes, prior.astype(np.float32), np.zeros((DENSE, DENSE), np.float32), w)
        own, edge = model.score(samples[:, :-1], samples[:, 1:])
        return -float((own + edge).astype(np.float64).mean())

    moved = attention.fit(samples, classes, prior, start, rate=1e-3)  # one step, against the sign of the gradient
    for name, place in [("out", (3, 5)), ("bias", (7,)), ("q", (2, 4)), ("q", (5, 6)), ("places", (9, 3)), ("ids", (int(samples[0, 3]), 2))]:
        up, down = ({**start, name: start[name].copy()} for _ in range(2))
        up[name][place] += 0.05
        down[name][place] -= 0.05
        slope = (loss(up) - loss(down)) / 0.1
        assert abs(slope) < 1e-4 or np.sign(start[name][place] - moved[name][place]) == np.sign(slope), name


def test_steep_weights_do_not_overflow():
    draw = np.random.default_rng(7)
    samples = draw.integers(0, DENSE, (40, LENGTH + 1))
    classes, prior, member = attention.counted(np.ones((DENSE, DENSE)), np.arange(DENSE) % 2 == 0)
    steep = {k: v * 200 if k != "bias" else v + 300 * (np.arange(attention.CLASSES) % 2) for k, v in attention.fit(samples, classes, prior, attention.begun()).items()}
    steep = {k: v.astype(np.float32) for k, v in steep.items()}
    assert all(np.isfinite(x).all() for x in attention.fit(samples, classes, prior, steep).values())
    model = attention.Model(np.arange(DENSE), np.zeros(DENSE), np.arange(DENSE) % 2 == 0, classes, prior.astype(np.float32), member.astype(np.float32), steep)
    assert not any(np.isnan(x).any() for x in model.score(samples[:, :-1], samples[:, 1:]))


def fit_input(windows):
    draw = np.random.default_rng(9)
    samples = draw.integers(0, DENSE, (windows, LENGTH + 1)).astype(np.uint16)
    classes, prior, _ = attention.counted(draw.integers(0, 4, (DENSE, DENSE)).astype(float), np.arange(DENSE) % 2 == 0)
    return samples, classes, prior.astype(np.float32)


def test_a_batch_is_fitted_within_the_cache():
    samples, classes, prior = fit_input(256)
    tracemalloc.start()
    try:
        attention.fit(samples, classes, prior, attention.begun())
        assert tracemalloc.get_traced_memory()[1] < 4 << 20
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("part", [7, 128])
def test_parts_of_a_batch_add_up(monkeypatch, part):
    given = fit_input(300)
    want = attention.fit(*given, attention.begun())
    monkeypatch.setattr(attention, "PART", part)
    got = attention.fit(*given, attention.begun())
    assert all(np.allclose(got[k], want[k], atol=1e-4) for k in want)


@pytest.mark.parametrize("skip", [0, LENGTH - attention.STRIDE])
def test_scores_do_not_depend_on_how_many_at_once(skip):
    model, _ = toy_model()
    ids, then = np.random.default_rng(10).integers(0, DENSE, (2, 75, LENGTH))
    alone = [np.concatenate(x) for x in zip(*(model.score(ids[i : i + 1], then[i : i + 1], skip) for i in range(75)), strict=True)]
    for at_once in (10, attention.PART, 75, 256):
        assert all(np.allclose(x, y, atol=1e-4) for x, y in zip(model.score(ids, then, skip, at_once), alone, strict=True))


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_scores_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(scoring, "BLOCK_BYTES", block)
    draw = np.random.default_rng(8)
    vocabulary = ["The", "the", "of", "été", "naïve,", "x\x85y", "\xa0z", "東京"] + ["".join(draw.choice(list("abcdef"), 5)) for _ in range(60)]
    texts = [None, "", " \n ", "the"] + [" ".join(draw.choice(vocabulary, draw.integers(1, 150))) for _ in range(150)] + ["of " * 30_000, "y" * 3000]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)] + [(None, "the of", 1), (7, "the", 2)], "doc_id long, text string, score int").repartition(3)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    train = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for t in train for w in words_of(t))
    n, v = sum(count.values()) + len(train), len(count) + 1
    want = Counter()
    for i, t in rows:
        w = words_of(t)
        base = sum(np.log10((count[x] + 1) / (n + v + 1)) for x in w) + np.log10((len(train) + 1) / (n + v + 1))
        want[(i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(w) + 1, sum(x in count for x in w) + 1, n, round(base, 6))] += 1
    got = scoring.score(df, RANKS, P.PATTERN, held()).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    kept_out = [r for r in got if r.held_out]
    assert sum(r.score for r in kept_out) > sum(r.base_score for r in kept_out)


def test_windows_overlap_by_eight():
    _, _, context = attention.windows(np.array([200]))
    assert context[0] == 0 and set(context[1:]) == {8}


@pytest.mark.parametrize("n", [2, 20, 32, 33, 34, 64, 65, 66, 1000])
def test_every_training_id_is_predicted(n):
    line = np.arange(n)
    found = attention.training_windows(line)
    assert found.shape[1] == LENGTH + 1 and set(line[1:]) <= set(found[:, 1:].reshape(-1)) and len(found) == max(1, -(-(n - 1) // LENGTH))


def test_all_training_texts_reach_the_weights(spark, monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK_BYTES", 2000)
    draw = np.random.default_rng(4)
    texts = [" ".join(draw.choice(["the", "of", "and", "some", "words"], 60)) for _ in range(80)]
    df = spark.createDataFrame([(i, t, i % 5 == 0) for i, t in enumerate(texts)], "id long, text string, held boolean").repartition(3, "id")
    table = scoring.blocks(df, RANKS, P.PATTERN)
    lines = [scoring._training_line(r.asDict(), np.zeros(scoring.RAW_IDS, int)) for r in table.collect()]
    model = scoring.learn(table, RANKS)
    assert len(lines) > 3 and model.fitted == sum(-(-(len(x) - 1) // LENGTH) for x in lines if len(x) > 1) > 100
    assert all(np.isfinite(x).all() for x in model.weights.values())


def test_long_unspaced_word(spark):
    long = "a1," * 70_000  # over 65,536 subword ids in one word
    texts = ["some words first", f"before {long} after", "and some words last", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").withColumn("held", F.lit(False)).coalesce(1)
    row = scoring.blocks(df, RANKS, P.PATTERN).collect()
    assert len(row) == 1
    _, _, raw, lens = scoring._texts(row[0].asDict())
    known = scoring._subwords(RANKS, P.PATTERN)
    want = [np.concatenate([known.ids(known.numbers([w]))[0] for w in words_of(t)] or [[]]) for t in (texts[i] for i in row[0].ids)]
    assert lens.tolist() == [len(w) for w in want] and max(lens) > 1 << 16
    assert raw.tolist() == np.concatenate(want).astype(int).tolist()


def test_unlikely_words_keep_their_scores(spark):
    by_model = np.array([-5.0, -700.0, -9000.0, -9000.0])
    by_counts = np.array([0.01, 0.0, 0.0, 1e-6])
    want = [np.log(0.8 * np.exp(-5.0) + 0.2 * 0.01), np.log(0.8) - 700, np.log(0.8) - 9000, np.log(0.2e-6)]
    assert np.allclose(scoring.mix(by_model, by_counts), want)
    train = [(i, "the of and some words", False) for i in range(40)]
    junk = [(100 + k, "q7x," * 150 * k, True) for k in (1, 2, 4)]
    df = spark.createDataFrame(train + junk, "doc_id long, text string, held boolean")
    got = {r.doc_id: r.score for r in scoring.score(df, RANKS, P.PATTERN, F.col("held")).collect()}
    assert 1.8 < got[102] / got[101] < 2.2 and 1.8 < got[104] / got[102] < 2.2


def test_empty(spark):
    df = spark.createDataFrame([(2, "a b")], "doc_id long, text string")
    assert scoring.score(df.limit(0), RANKS, P.PATTERN, held()).count() == 0
    r = scoring.score(df, RANKS, P.PATTERN, F.lit(True)).collect()[0]
    assert (r.n_known, r.train_tokens, r.n_tokens, r.base_score) == (0, 0, 3, 0.0) and np.isfinite(r.score)
