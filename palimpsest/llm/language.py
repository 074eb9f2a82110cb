"""Language identification by Bayesian fusion of text, declared language, address suffix and host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_small, let_go, materialize, scratched, text_slices, texts_of

#: Buckets of byte trigrams, and rows of each declared language (about, by hash) that the text model is fitted on.
BUCKETS, FIT_ROWS = 1 << 15, 2000
#: Bytes of text whose trigrams are looked at together; each takes some 50 bytes meanwhile.
TRIGRAM_BYTES = 512 << 10
#: A text counts as this many independent trigrams at most; neighbours overlap, so a long text isn't endlessly sure.
INDEPENDENT, PER_TRIGRAM = 60.0, 0.25
#: Rows that the level above weighs in a host's and a suffix's prior, and rows that are added to each declared language.
PRIOR_ROWS, DECLARED_ROWS = 20.0, 1.0
#: Posterior that a language must reach; below, a row is undetermined.
SURE = 0.5


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte trigrams of the lower-cased texts, in a row, and each text's count. Texts are framed by blanks."""
    raw = [f" {t.lower()} ".encode("utf-8", "replace") for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    b = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(len(raw), np.int64)
    mixed = ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    counts = np.maximum(sizes - 2, 0)
    starts = np.cumsum(sizes) - sizes
    inside = np.ones(len(b), bool)
    ends = (starts + sizes)[sizes > 0]
    inside[ends - 1] = False
    inside[np.maximum(ends - 2, 0)] = False
    return mixed[inside[: len(mixed)]].astype(np.int64), counts


def fit_text(df: DataFrame, text: str, declared: str, rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and the log-likelihood of each trigram bucket in each, from about `rows` rows a declared language.

    Rows are drawn by a hash of the text, so the draw is the same in every run. Languages: all declared ones. What
    reaches the driver is one count for each language and bucket that occur together.
    """
    there = df.where(F.col(declared).isNotNull()).groupBy(declared).count().collect()
    languages = sorted(r[0] for r in there)
    if not languages:
        return [], np.zeros((BUCKETS, 0), np.float32)
    share = F.create_map(*(F.lit(x) for r in there for x in (r[0], min(1.0, rows / r[1]))))
    drawn = df.where(F.col(declared).isNotNull()).select(F.col(declared).alias("l"), F.col(text).alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(1 << 20)) <= share[F.col("l")] * (1 << 20))
    place = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in text_slices(batches, "t", TRIGRAM_BYTES):
            ids, sizes = trigrams(texts_of(batch, "t"))
            own = np.array([place[x] for x in batch.column("l").to_pylist()], np.int64)
            at, n = np.unique(np.repeat(own, sizes) * BUCKETS + ids, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n, pa.int64())], ["cell", "n"])

    cells = drawn.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((len(languages), BUCKETS), 0.5)
    table.reshape(-1)[cells["cell"].to_numpy(np.int64)] += cells["n"].to_numpy(np.float64)
    return languages, np.log(table / table.sum(1, keepdims=True)).T.astype(np.float32).copy()


def score_text(df: DataFrame, text: str, table: np.ndarray, to: str = "text_scores", keep_text: bool = False) -> DataFrame:
    """df with the tempered log-likelihood of each language over the whole text, and whether it has any letter."""
    kept = [c for c in df.columns if c not in (text, to, "has_letter")] + [text] * keep_text
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    shared = df.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        weights = shared.value
        for batch in text_slices(batches, text, TRIGRAM_BYTES):
            texts = texts_of(batch, text)
            ids, sizes = trigrams(texts)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            sums = np.empty((len(texts), weights.shape[1]))
            for k in range(weights.shape[1]):
                upto = np.concatenate([[0.0], np.cumsum(weights[:, k][ids], dtype=np.float64)])
                sums[:, k] = upto[ends[1:]] - upto[ends[:-1]]
            many = np.maximum(sizes, 1)
            sums *= (np.minimum(PER_TRIGRAM * many, INDEPENDENT) / many)[:, None]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(list(sums), pa.list_(pa.float64())), pa.array([any(map(str.isalpha, t)) for t in texts], pa.bool_())], [*kept, to, "has_letter"])

    return df.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + f", `{to}` array<double>, has_letter boolean")


def _smoothed(rows: DataFrame, by: list[str], above: DataFrame | Column, up: list[str], n: int) -> DataFrame:
    """For each key in `by` an array: the share of each language among its rows, PRIOR_ROWS rows of the level above added. above: shares for each key
    in `up`, or for all."""
    own = rows.groupBy(*by).agg(F.sum("n").alias("__n"), *(F.sum(F.when(F.col("guess") == k, F.col("n")).otherwise(0)).alias(f"__{k}") for k in range(n)))
    if isinstance(above, Column):
        met = own.withColumn("__up", above)
    else:
        above = above.withColumnRenamed("share", "__up")
        met = own.join(above, [F.col(c).eqNullSafe(above[f"up_{c}"]) for c in up], "left")
    shares = F.array(*((F.col(f"__{k}") + PRIOR_ROWS * F.get("__up", F.lit(k))) / (F.col("__n") + PRIOR_ROWS) for k in range(n)))
    return met.select(*by, shares.alias("share"))


def suffix_of(host: str | Column) -> Column:
    """What follows the last dot of a host's name; null if it has none."""
    found = F.lower(F.regexp_extract(F.col(host) if isinstance(host, str) else host, r"\.([A-Za-z]{2,63})\.?$", 1))
    return F.when(found != "", found)


@scratched
def identify(df: DataFrame, text: str = "text", declared: str = "lang", host: str | Column = "source", suffix: str | Column | None = None, keep_text: bool = False) -> DataFrame:
    """df, without its text unless keep_text, with language string, confidence double, text_language string, kept boolean.

    log P(language | all) = tempered log P(text | language) + log P(declared | language) + log P(language | host), up to a
    constant. P(declared | language): counted over all rows, by the text's own guess. P(language | host): the host's counts
    smoothed by its suffix's, those by all rows'. A row without a declared language, host or suffix has no such evidence (null
    is a level of its own). `und`, not kept: the text has no letter, or no language reaches SURE. Declared languages are only
    evidence: a wrong one never rejects a row. Ties: the language that sorts first. No declared language anywhere: all `und`.
    Empty table: no rows. Columns of the names added are replaced.
    """
    added = ["language", "confidence", "text_language", "kept"]
    df = df.drop(*added)
    host = F.col(host) if isinstance(host, str) else host
    suffix = F.lit(None).cast("string") if suffix is None else F.col(suffix) if isinstance(suffix, str) else suffix
    languages, table = fit_text(df, text, declared)
    n = len(languages)
    rows = df.withColumns({"__host": host, "__suffix": suffix, "__declared": F.col(declared)})
    if not n:
        return df.drop(*([] if keep_text else [text])).withColumns({"language": F.lit("und"), "confidence": F.lit(0.0), "text_language": F.lit("und"), "kept": F.lit(False)})
    rows = materialize(score_text(rows, text, table, "__scores", keep_text).withColumnRenamed("has_letter", "__letter"), "language")
    best = lambda scores: (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
    counts = rows.where("__letter").select("__host", "__suffix", "__declared", best(F.col("__scores")).alias("guess")).groupBy("__host", "__suffix", "__declared", "guess").agg(F.count("*").alias("n"))
    counts = materialize(counts, "evidence")
    total = {r.guess: r.n for r in counts.groupBy("guess").agg(F.sum("n").alias("n")).collect()}
    seen = sum(total.values())
    everywhere = [(total.get(k, 0) + 1.0) / (seen + n) for k in range(n)]
    by_suffix = _smoothed(counts, ["__suffix"], F.array(*map(F.lit, everywhere)), [], n)
    by_host = materialize(_smoothed(counts, ["__host", "__suffix"], by_suffix.withColumnRenamed("__suffix", "up___suffix"), ["__suffix"], n), "hosts")
    spread = counts.groupBy("__declared").agg(*(F.sum(F.when(F.col("guess") == k, F.col("n")).otherwise(0)).alias(f"__{k}") for k in range(n)))
    kinds = spread.count()
    said = F.array(*((F.col(f"__{k}") + DECLARED_ROWS) / F.lit(total.get(k, 0) + DECLARED_ROWS * max(kinds, 1)) for k in range(n)))
    by_declared = materialize(spread.select("__declared", said.alias("said")), "declared")
    met = join_small(rows, by_host, ["__host", "__suffix"], ["__scores"])
    met = join_small(met, by_declared, ["__declared"], ["__scores"])
    flat, none = F.array(*map(F.lit, everywhere)), F.array_repeat(F.lit(1.0), n)
    log = lambda x: F.transform(x, lambda v: F.ln(v))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    met = met.withColumn("__all", plus(plus(F.col("__scores"), log(F.coalesce("share", flat))), log(F.when(F.col("__declared").isNull(), none).otherwise(F.coalesce("said", none)))))
    met = met.withColumn("__mass", F.aggregate(F.transform("__all", lambda x: F.exp(x - F.array_max("__all"))), F.lit(0.0), lambda a, x: a + x))
    names = F.array(*map(F.lit, languages))
    sure = F.col("__letter") & (1 / F.col("__mass") >= SURE)
    met = met.withColumns({"language": F.when(sure, F.get(names, best(F.col("__all")))).otherwise("und"), "confidence": F.when(F.col("__letter"), 1 / F.col("__mass")).otherwise(0.0), "text_language": F.when(F.col("__letter"), F.get(names, best(F.col("__scores")))).otherwise("und"), "kept": sure})
    return met.select(*[c for c in df.columns if c != text or keep_text], *added)
