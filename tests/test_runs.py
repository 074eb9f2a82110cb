import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.operators import runs as cuts
from palimpsest.operators.log import LOG_SCHEMA


def greedy(sizes, threshold):
    out, run, held = [], 1, 0
    for s in sizes:
        out.append(run)
        held += s
        if held >= threshold:
            run, held = run + 1, 0
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(24, 90), min_size=1, max_size=120), st.integers(24, 400), st.integers(1, 40))
def test_functions_of_stretches_put_together(sizes, threshold, each):
    sums, functions, start, run, got = np.cumsum(sizes), [], 0, 1, []
    for k in range(0, len(sizes), each):
        functions.append(cuts._steps(sums[k : k + each], int(sums[k - 1]) if k else 0, threshold))
    whole = tuple(np.zeros(0, np.int64) for _ in range(3))
    for k, f in enumerate(functions):
        own = sums[k * each : (k + 1) * each]
        ends = cuts._ends(own, start, threshold)
        got += (run + (np.arange(len(own))[:, None] > ends).sum(1)).tolist()
        start, more = cuts._apply(*f, start)
        run += more
        whole = cuts._compose(whole, f)
        assert cuts._apply(*whole, 0) == (start, run - 1)
    assert got == greedy(sizes, threshold)


def frame(spark, rows):
    return spark.createDataFrame([(bytearray(k), s, None if v is None else bytearray(v)) for k, s, v in rows], LOG_SCHEMA)


@pytest.mark.parametrize("rows_each, fan_in", [(None, 64), (7, 64), (1, 3), (50, 2)])
def test_cut(spark, monkeypatch, rows_each, fan_in):
    monkeypatch.setattr(cuts, "FAN_IN", fan_in)
    draw = random.Random(3)
    rows = [(b"k" * draw.randint(0, 20), s, draw.choice([None, b"", b"v" * draw.randint(1, 300)])) for s in range(5, 205)]
    got = {r.seq: r.run for r in cuts.cut(frame(spark, draw.sample(rows, len(rows))), 700, rows_each).collect()}
    want = greedy([len(k) + len(v or b"") + 24 for k, _, v in rows], 700)
    assert [got[s] for _, s, _ in rows] == want


def test_equal_sizes_have_a_closed_form(spark):
    rows = [(b"0123456789", s, b"x" * 16) for s in range(1, 501)]
    got = cuts.cut(frame(spark, rows), 500, 40).groupBy("run").count().collect()
    assert all(r["count"] == 10 for r in got) and len(got) == 50


def test_sizes_and_empty(spark):
    log = frame(spark, [(b"ab", 1, b"xyz"), (b"ab", 2, None), (b"", 3, b"")])
    assert tuple(cuts.buffer_size(log).first()) == (3, 29 + 26 + 24)
    assert tuple(cuts.buffer_size(log.limit(0)).first()) == (0, 0)
    assert cuts.cut(log.limit(0)).count() == 0
    assert tuple(cuts.stats(cuts.run_meta(cuts.cut(log.limit(0)))).first()) == (0, 0, 0, 0)


def test_an_entry_over_the_threshold_is_a_run(spark):
    log = frame(spark, [(b"a", 1, b"x" * 9000), (b"b", 2, b"y"), (b"c", 3, b"z" * 9000)])
    assert [r.run for r in cuts.cut(log, 100).orderBy("seq").collect()] == [1, 2, 2]


def test_meta_and_pruning(spark):
    log = frame(spark, [(b"apple", 1, b"red"), (b"banana", 2, b"yellow"), (b"cherry", 3, None)])
    meta = cuts.run_meta(cuts.cut(log, 1 << 20))
    r = meta.first()
    assert (r.entry_count, bytes(r.min_key), bytes(r.max_key), r.min_seq, r.max_seq) == (3, b"apple", b"cherry", 1, 3)
    for key, there in ((b"apple", 1), (b"b", 1), (b"cherry", 1), (b"a", 0), (b"cherryx", 0)):
        assert cuts.might_contain(meta, bytearray(key)).count() == there
    assert tuple(cuts.stats(meta, 1 << 20).first()) == (3, r.bytes, 0, 3) and tuple(cuts.stats(meta, 10).first()) == (0, 0, 1, 3)
