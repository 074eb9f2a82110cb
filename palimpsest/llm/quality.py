"""Quality rules with adaptive thresholds from mergeable quantile sketches, in DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, join_small, materialize, scratched

SYMBOLS = "[#*$%&|<>]"
HAS_WORD = r"[^\x20\x09-\x0D]"
#: Words of a window that counts as repeated.
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A share, (n + smooth) / (of + typical): a document of typical size with `smooth` occurrences is added. Or, without `smooth`, the mean
    n / of, with a document of typical size and mean added. A row goes if this lies above its group's fence, unless it has no occurrence at all; and
    for means also if it lies below."""

    metric: str
    n: str
    of: str
    smooth: int = 0


#: No rule has a cutoff: what is typical, the middle and the spread all come from the rows.
RULES = (Rule("symbols", "n_symbols", "word_chars", 1), Rule("dup_lines", "n_dup_lines", "__n_lines", 1), Rule("repeats", "n_repeat_words", "n_words", WINDOW), Rule("word_length", "word_chars", "n_words"))
#: Width of a sketch's buckets on the scale of logarithms: quantiles are exact to 0.2 %.
STEP = 0.004
#: Standard deviations that a fence lies beyond the median; quantiles, in percent, that they're estimated from, and where these lie in a normal distribution:
#: the quartile's estimate, or the decile's if that's larger, but then at most so many times the quartile's. Up to a quarter of a group may be junk.
SPREAD, QUARTILE, DECILE, TAIL = 6.0, (75, 0.6745), (90, 1.2816), 1.5
#: Different rows past the base checks that a (language, source) needs for its own fences; else its language's, else all rows' fences hold.
GROUP_ROWS = 200


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed boolean, over whole texts.

    Null and empty texts have no words. A line counts as duplicate if it has a word and equals an earlier line. A word
    counts as repeated if it lies in a window of five words that the text has twice or more (64-bit hashes of windows
    are compared). Columns of these names are replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("__w", F.array_remove(F.split(whole, WORD_GAP), ""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(HAS_WORD))
    n = F.size("__w")
    word = lambda i, k: F.get(F.col("__w"), i + k)
    grams = F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(word(i, F.lit(k)) for k in range(WINDOW)))))
    out = out.withColumn("n_words", n.cast("long")).withColumn("word_chars", F.length(F.array_join("__w", "")).cast("long"))
    out = out.withColumn("n_symbols", (F.length(whole) - F.length(F.regexp_replace(whole, SYMBOLS, ""))).cast("long"))
    out = out.withColumn("__l", lines).withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long")).withColumn("__g", grams)
    # Only texts that have a window twice are looked into: the places of such windows, in order, and how far each reaches.
    placed = F.sort_array(F.transform("__g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    out = out.withColumn("__p", F.when(F.size("__g") != F.size(F.array_distinct("__g")), placed))
    near = lambda i: F.coalesce(F.get(F.col("__p"), i)["g"], F.lit(None).cast("long"))
    twice = F.filter(F.transform("__p", lambda x, i: F.when(x["g"].eqNullSafe(near(i - 1)) & (i > 0) | x["g"].eqNullSafe(near(i + 1)), x["i"])), lambda x: x.isNotNull())
    out = out.withColumn("__t", F.sort_array(twice))
    reach = F.transform("__t", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("__t"), k + 1) - x, F.lit(WINDOW))))
    out = out.withColumn("n_repeat_words", F.coalesce(F.aggregate(reach, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    out = out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return out.withColumn("__n_lines", F.size("__l")).drop("__w", "__l", "__g", "__p", "__t")


def bucket(x: Column) -> Column:
    """Where a positive number lies in a sketch."""
    return F.floor(F.ln(x) / STEP).cast("long")


def _quantile(ranked: Column, rows: Column, percent: int) -> Column:
    """Of a sketch, an array of (bucket, n) in order, the first bucket up to which so many percent of the rows lie."""
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("long").alias("found"))

    def step(a: Column, x: Column) -> Column:
        upto = a["upto"] + x["n"]
        return F.struct(upto.alias("upto"), F.when(a["found"].isNull() & (100 * upto >= percent * rows), x["bucket"]).otherwise(a["found"]).alias("found"))

    return F.aggregate(ranked, start, step)["found"]


def sketch(df: DataFrame, values: dict[str, Column], by: list[str]) -> DataFrame:
    """Mergeable quantile sketches, (group, metric, bucket, n): how many rows of a group have a value in each bucket, and buckets are as wide
    in proportion everywhere. Sketches of parts add up exactly, in any order, so quantiles are the same in every run."""
    pairs = F.explode(F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*map(bucket, values.values()))))
    return df.select(*by, pairs.alias("metric", "bucket")).groupBy(*by, "metric", "bucket").agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of larger groups from those of smaller ones."""
    return sketches.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))


def spreads(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(group, metric, rows, middle, up, down): the median, and the standard deviation above and below it as the quantiles have it, in buckets.
    A sketch has as many rows as buckets that occur, some thousands at most, whatever the number of rows."""
    percents = [10, 25, 50, 75, 90]
    gathered = sketches.groupBy(*by, "metric").agg(F.sum("n").alias("rows"), F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("all"))
    found = gathered.select(*by, "metric", "rows", *(_quantile(F.col("all"), F.col("rows"), p).alias(f"q{p}") for p in percents))

    def wide(near: Column, far: Column) -> Column:
        near, far = near / QUARTILE[1], far / DECILE[1]
        return F.when(near == 0, far).otherwise(F.greatest(near, F.least(far, TAIL * near)))

    up, down = wide(F.col("q75") - F.col("q50"), F.col("q90") - F.col("q50")), wide(F.col("q50") - F.col("q25"), F.col("q50") - F.col("q10"))
    return found.select(*by, "metric", "rows", F.col("q50").alias("middle"), up.alias("up"), down.alias("down"))


def _values(rules: tuple[Rule, ...], typical: dict[str, float]) -> dict[str, Column]:
    out = {}
    for r in rules:
        if r.smooth:
            out[r.metric] = (F.col(r.n) + F.lit(float(r.smooth))) / (F.col(r.of) + F.lit(typical[r.of]))
        else:
            out[r.metric] = (F.col(r.n) + F.lit(typical[r.of] * typical[r.metric])) / (F.col(r.of) + F.lit(typical[r.of]))
    return out


@dataclass(frozen=True)
class Fences:
    """typical: median sizes of documents, and median means; groups: (__gl, __gs) and for each rule its low and high fence."""

    typical: dict[str, float]
    groups: DataFrame


def fit(measured: DataFrame, lang: str = "lang", source: str = "source", rules: tuple[Rule, ...] = RULES, group_rows: int = GROUP_ROWS) -> Fences | None:
    """The fences of each (language, source) of measured rows: a few numbers a group. None if no row passed the base checks.

    They come from the rows that passed the base checks; rows that agree in all measures count once, so that copies don't set
    them. A group with fewer than `group_rows` takes its language's fences, a language with fewer those of all rows. Its standard
    deviation counts as half of the groups' median one at least: a group of near copies has next to none. Sketches are merged up,
    rows are read twice.
    """
    used = list(dict.fromkeys(c for r in rules for c in (r.n, r.of)))
    passed = measured.where(~F.col("base_failed")).select(F.col(lang).alias("__lang"), F.col(source).alias("__source"), *used)
    passed = materialize(passed.distinct(), "passed")
    sizes = {c: F.col(c).cast("double") for c in dict.fromkeys(r.of for r in rules)} | {r.metric: F.col(r.n) / F.col(r.of) for r in rules if not r.smooth}
    middles = {r["metric"]: r["middle"] for r in spreads(sketch(passed, sizes, []), []).collect()}
    if not middles:
        return None
    typical = {k: math.exp((b + 0.5) * STEP) for k, b in middles.items()}
    fine = materialize(sketch(passed, _values(rules, typical), ["__lang", "__source"]), "sketch")
    coarse = merged(fine, ["__lang"])
    by_own, by_lang = (materialize(spreads(x, by), "spreads") for x, by in ((fine, ["__lang", "__source"]), (coarse, ["__lang"])))
    usual = by_own.groupBy("metric").agg(F.coalesce(F.median(F.when(F.col("rows") >= group_rows, F.col("up"))), F.lit(0.0)).alias("up"), F.coalesce(F.median(F.when(F.col("rows") >= group_rows, F.col("down"))), F.lit(0.0)).alias("down"))
    usual = {r["metric"]: r for r in usual.collect()}
    overall = {r["metric"]: r for r in spreads(merged(coarse, []), []).collect()}

    def wide(found: DataFrame, by: list[str], mark: str) -> DataFrame:
        out = [F.max("rows").alias(f"{mark}rows")]
        for r in rules:
            mine, least = F.col("metric") == r.metric, usual[r.metric]
            high = F.col("middle") + SPREAD * F.greatest(F.col("up"), F.lit(least["up"] / 2))
            low = F.col("middle") - SPREAD * F.greatest(F.col("down"), F.lit(least["down"] / 2))
            out += [F.max(F.when(mine, high)).alias(f"{mark}high_{r.metric}"), F.max(F.when(mine, low)).alias(f"{mark}low_{r.metric}")]
        return found.groupBy(*by).agg(*out)

    own, per = wide(by_own, ["__lang", "__source"], "o_"), wide(by_lang, ["__lang"], "l_")
    met = own.join(per.withColumnRenamed("__lang", "__l2"), F.col("__lang").eqNullSafe(F.col("__l2")), "left")
    every = {f"high_{m}": x["middle"] + SPREAD * x["up"] for m, x in overall.items()} | {f"low_{m}": x["middle"] - SPREAD * x["down"] for m, x in overall.items()}
    pick = lambda c: F.when(F.col("o_rows") >= group_rows, F.col(f"o_{c}")).when(F.col("l_rows") >= group_rows, F.col(f"l_{c}")).otherwise(F.lit(every[c]))
    names = [f"{side}_{r.metric}" for r in rules for side in ("low", "high")]
    return Fences(typical, materialize(met.select(F.col("__lang").alias("__gl"), F.col("__source").alias("__gs"), *(pick(c).alias(f"__{c}") for c in names)), "fences"))


def apply(measured: DataFrame, fences: Fences | None, lang: str = "lang", source: str = "source", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """measured with kept boolean. The fences are few numbers a group; see join_small()."""
    if fences is None:
        return measured.withColumn("kept", ~F.col("base_failed")).drop("__n_lines")
    chosen = fences.groups.withColumnsRenamed({"__gl": lang, "__gs": source})
    joined = join_small(measured, chosen, [lang, source], ["word_chars", "n_words", "n_symbols", "n_repeat_words"])
    fits, values = ~F.col("base_failed"), _values(rules, fences.typical)
    for r in rules:
        at = bucket(values[r.metric])
        inside = at <= F.col(f"__high_{r.metric}")
        inside = inside | (F.col(r.n) == 0) if r.smooth else inside & (at >= F.col(f"__low_{r.metric}"))
        fits &= F.coalesce(inside, F.lit(True))
    return joined.withColumn("kept", fits).drop(*(c for c in chosen.columns if c[:2] == "__"), "__n_lines")


@scratched
def judge(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", carry_text: bool = True, rules: tuple[Rule, ...] = RULES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """df with the columns of measure() and kept boolean: passed the base checks and lies within its group's fences.

    Groups are (language, source); null is a group of its own. If no row passed the base checks, nothing is fenced. A row at a
    fence is kept. Empty table: no rows. Each text is measured once; the measured rows go to the scratch folder, without
    the text if `carry_text` is false.
    """
    rows = measure(df, text)
    rows = materialize(rows if carry_text else rows.drop(text), "measured")
    return apply(rows, fit(rows, lang, source, rules, group_rows), lang, source, rules)
