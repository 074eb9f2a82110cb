import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import common, quality, sharding


def test_rendezvous_moves_only_into_the_new_shard(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("slot"))
    got = sharding.assign(rows, "doc_id", [1.0] * 8, [1.0] * 9, bucket_rows=100).collect()
    assert all(r.grown_shard in (r.shard, 8) for r in got)
    moved = sum(r.grown_shard == 8 for r in got)
    assert 0.8 < moved / (len(got) / 9) < 1.2
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_weights(spark):
    n = Counter(r.shard for r in sharding.assign(spark.range(20_000), "id", [1.0, 3.0]).collect())
    assert 2.8 < n[1] / n[0] < 3.2
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("id"), [1.0, 0.0])


def test_edge_rows(spark):
    rows = spark.createDataFrame([(None, "a"), (None, None), (1, "x"), (1, "x"), (1, "x")], "k long, shard string")
    got = sharding.assign(rows, "k", [1.0] * 4).collect()
    assert len(got) == 5 and len({r.shard for r in got if r.k == 1}) == 1 and sorted(r.slot for r in got if r.k == 1)[-1] >= 2
    assert sharding.assign(rows.limit(0), "k", [1.0]).count() == 0


def test_a_hot_key_is_numbered_where_it_lies(spark):
    rows = spark.range(9000, numPartitions=6).selectExpr("case when id % 3 = 0 then 7 else id end k", "case when id % 2 = 0 then 'x' end t")
    got = sharding.assign(rows, "k", [1.0] * 4, tie=["t"], bucket_rows=100)
    order = {}
    for r in got.collect():
        order.setdefault(r.shard, []).append((r.slot, r.k, r.t))
    assert got.columns == ["k", "t", "shard", "slot"]
    for s in order.values():
        assert sorted(x[0] for x in s) == list(range(len(s)))
        runs = [k for (_, k, t), (_, k2, t2) in zip(sorted(s, key=lambda x: x[0]), sorted(s, key=lambda x: x[0])[1:]) if (k, t) != (k2, t2)]
        assert len(runs) == len({(k, t) for _, k, t in s}) - 1  # equal rows are together


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered), "base_failed": len(w) < 10 or 100 * len(covered) > 20 * len(w),
    }


TEXTS = [
    None, "", " \n\t", "a b c d e", "a b c d e a b c d e", "a a a a a a a", "x\ny\nx\n x\n \n \n\r\n\r", "é😀 " * 30, "one two three four five six seven eight nine ten",
    "a b c d e f g h i j k l " * 2 + "m n o p q r s t u v w x y z " * 9, "#*$ | < > & %", "w\x0bw\x0cw\x1cw\x85w\xa0w", " ".join(map(str, range(30_000))), "z y x w v " * 5000,
]


def test_measures_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, "kept", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, kept string, __w int").drop("__w")
    for r in quality.measure(df).collect():
        want = brute(r.text)
        assert {k: r[k] for k in want} == want, r.text


def documents(spark):
    clean = [(i, f"w{i} " + " ".join(f"word{(i * 7 + j * j) % 97}x{j}" for j in range(30 + i % 60)), "en", f"s{i % 3}") for i in range(900)]
    noisy = [(1000 + i, " ".join(f"word{(i + j * j) % 97}x{j}###" for j in range(60)), "en", "s0") for i in range(15)]
    odd = [(2000, None, None, None), (2001, "", "en", None), (2002, " ".join(f"word{(j * j) % 91}x{j}" for j in range(50)), None, "s0")]
    return spark.createDataFrame(clean + noisy + odd, "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("broadcast", [16 << 20, 0])
def test_adaptive_fences(spark, monkeypatch, broadcast):
    monkeypatch.setattr(common, "BROADCAST_BYTES", broadcast)
    got = {r.doc_id: r.kept for r in quality.judge(documents(spark)).collect()}
    assert len(got) == 918
    assert all(got[i] for i in range(900)) and not any(got[1000 + i] for i in range(15))
    assert not got[2000] and not got[2001] and got[2002]


def code(i):
    return f"w{i} " + " ".join(f"name{(i * 7 + j * j) % 97}{'x' * ((i + j) % 5)}" + ("$#$#$" if j * (i % 9 + 1) % 4 == 0 else "") for j in range(30 + i % 60))


def prose(i):
    return f"w{i} " + " ".join(f"name{(i * 7 + j * j) % 97}{'x' * ((i + j) % 5)}" for j in range(30 + i % 60))


def test_the_same_text_fares_unlike_in_unlike_sources(spark):
    rows = [(i, code(i), "en", "code") for i in range(400)] + [(1000 + i, prose(i), "en", "prose") for i in range(400)]
    rows += [(5000 + i, code(i), "en", "prose") for i in range(10)]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(400)) and all(got[1000 + i] for i in range(400))
    assert not any(got[5000 + i] for i in range(10))


def test_copies_do_not_set_the_fences(spark):
    rows = [(i, prose(i), "en", "a") for i in range(400)] + [(1000 + i, prose(3), "en", "a") for i in range(1200)]
    near = [(5000 + i, f"other{i:04d} " + prose(500), "en", "b") for i in range(900)] + [(9000 + i, prose(i), "en", "b") for i in range(100)]
    got = quality.judge(spark.createDataFrame(rows + near, "doc_id long, text string, lang string, source string")).collect()
    assert all(r.kept for r in got)


def test_quantiles_are_those_of_the_rows(spark):
    values = [1.0 + 3 * k / 1000 for k in range(1000)]
    df = spark.createDataFrame([(v, k % 2) for k, v in enumerate(values)], "v double, g int").repartition(7)
    found = quality.spreads(quality.merged(quality.sketch(df, {"m": F.col("v")}, ["g"]), []), []).first()
    log = lambda q: math.log(sorted(values)[math.ceil(q * len(values)) - 1]) / quality.STEP
    near, far = ([abs(log(q) - log(0.5)) for q in x] for x in ((0.75, 0.25), (0.9, 0.1)))
    want = [max(a / quality.QUARTILE[1], min(b / quality.DECILE[1], quality.TAIL * a / quality.QUARTILE[1])) for a, b in zip(near, far, strict=True)]
    assert found["rows"] == 1000 and abs(found.middle - log(0.5)) <= 1 and abs(found.up - want[0]) < 3 and abs(found.down - want[1]) < 3


def test_sketches_merge(spark):
    df = quality.measure(documents(spark))
    values = {"w": F.col("n_words") + 1.0}
    whole = quality.sketch(df, values, ["lang"])
    parts = quality.sketch(df.where("doc_id % 2 = 0"), values, ["lang"]).union(quality.sketch(df.where("doc_id % 2 = 1"), values, ["lang"]))
    assert sorted(map(str, whole.collect())) == sorted(map(str, quality.merged(parts, ["lang"]).select(whole.columns).collect()))


def test_empty(spark):
    assert quality.judge(documents(spark).limit(0)).count() == 0


def test_crc_is_zlibs(spark):
    assert spark.range(1).select(F.crc32(F.lit("é").cast("binary"))).first()[0] == zlib.crc32("é".encode())


def test_native_plans(spark, tmp_path):
    """No Python between the scan and the result."""
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for out in (quality.judge(docs), quality.measure(docs), sharding.assign(docs.select("doc_id"), "doc_id", [1.0] * 4, [1.0] * 5)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow")), plan
