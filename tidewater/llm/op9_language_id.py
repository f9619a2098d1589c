"""Language identification by rank-order profiles of n-grams.

A text's words (runs of letters, lower case, between marks of their ends) give n-grams of 1 to 3
characters, counted over the whole text. The PROFILE most frequent, in the order of
count and then code, are its profile. A language's profile is that of its training
documents. The distance of a text to a language is the sum of how far out of place each
of its n-grams stands there, PROFILE for one that is absent; the smallest wins.

Training takes, for each language, about SAMPLE documents (a hash of the row's id and place
under a bound that follows from the language's count, so rows that share an id are
chosen one by one) of those that are not held out; their n-gram counts are summed by language
and n-gram in the cluster. PROFILE rows a language reach the driver and the workers,
where a list by n-gram holds them, however many languages there are. lang, source and
doc_id are not inputs of a prediction.

The score is the runner-up's share of the two smallest distances, from 0.5 to 1; it is
0 for `und`. `rejected` marks texts that no profile resembles: `und`, or a distance of
at least REJECT of the largest possible one.

Defined results: null texts and those without a letter (Unicode's class L) are `und`, score 0; texts of any
length are counted whole; ties go to the language that sorts first; without a training row every text is `und`; rows that
repeat get a row each; a null id is not held out, and not trained on; an empty table gives no rows; other columns are
ignored, or passed on where they are to be kept, and one of the name of a result gives way to it.
"""

from __future__ import annotations

import collections
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns, documents, fold, ship, small, stored, worker_state

PROFILE = 300
SAMPLE = 1_000
REJECT = 0.97
#: Languages whose counts are broadcast.
SIZES = 100_000
WORD = re.compile(r"[^\W\d_]+")
RESULTS = ("lang_pred", "score", "rejected")


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a text's 1- to 3-grams, ascending, and how often each stands there.

    The distinct words stand in one string between spaces, which mark their ends; an
    n-gram counts as often as its word. A code is a code point in each 21 bits."""
    seen = collections.Counter(WORD.findall(text.lower()))
    for w in [w for w in seen if not w.isalpha()]:  # with numerals that aren't digits
        n = seen.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            seen[part] += n
    if not seen:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.frombuffer(f" {' '.join(seen)} ".encode("utf-32-le"), "<u4").astype(np.int64)
    times = np.repeat(list(seen.values()), [len(w) + 1 for w in seen])  # of each character and the space after it
    two = c[:-1] << 21 | c[1:]
    inside = c[1:-1] != 32
    codes = np.concatenate([c[1:-1][inside], two, (c[:-2] << 42 | two[1:])[inside]])
    n = np.concatenate([times[:-1][inside], times, times[:-1][inside]])
    order = np.argsort(codes)
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(n, first)


def profile(text: str) -> np.ndarray:
    """The codes of the PROFILE most frequent n-grams."""
    codes, n = counts(text)
    if len(n) > PROFILE:
        most = n >= np.partition(n, -PROFILE)[-PROFILE]
        codes, n = codes[most], n[most]
    return codes[np.lexsort((codes, -n))[:PROFILE]]


class Profiles:
    """Out-of-place distances to the languages' profiles, all at once, by a list of (language, rank) for each n-gram."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = sorted(profiles)
        sizes = [len(profiles[lang]) for lang in self.langs]
        codes = np.array([c for lang in self.langs for c in profiles[lang]], np.int64)
        order = np.argsort(codes, kind="stable")
        self.codes, first = np.unique(codes[order], return_index=True)
        self.first = np.append(first, len(codes))
        self.lang = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.rank = np.concatenate([np.arange(n) for n in sizes] or [np.zeros(0, np.int64)])[order]

    def nearest(self, profile: np.ndarray) -> tuple[str, float, bool]:
        """Language, score, rejected."""
        if not len(profile) or not self.langs:
            return "und", 0.0, True
        at = np.searchsorted(self.codes, profile)
        at[at == len(self.codes)] = 0
        place = np.flatnonzero(self.codes[at] == profile)
        begin, end = self.first[at[place]], self.first[at[place] + 1]
        n = end - begin
        entry = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        nearer = PROFILE - np.abs(self.rank[entry] - np.repeat(place, n))
        apart = PROFILE * len(profile) - np.bincount(self.lang[entry], nearer, len(self.langs)).astype(np.int64)
        order = np.argsort(apart, kind="stable")
        best = int(apart[order[0]])
        other = int(apart[order[1]]) if len(order) > 1 else PROFILE * len(profile)
        return self.langs[order[0]], other / (best + other) if other else 0.5, best >= REJECT * PROFILE * len(profile)


def language_profiles(docs: DataFrame) -> dict[str, list[int]]:
    """Each language's profile from docs (doc_id, text, lang), held-out rows aside."""
    ship(docs.sparkSession)
    train = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 3) != 1) & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = stored(train.groupBy("lang").agg(F.count("*").alias("n")))
    share = F.pmod(F.xxhash64("doc_id", "place"), F.lit(1 << 20)) / float(1 << 20)
    chosen = train.withColumn("place", F.monotonically_increasing_id()).join(small(sizes, SIZES), "lang").filter(share < SAMPLE / F.col("n")).select("lang", "text")

    def count(batches):
        sums: dict = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = sums.setdefault(lang, {})
                for c, n in zip(*(x.tolist() for x in counts(text))):
                    own[c] = own.get(c, 0) + n
        for lang, own in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(own), pa.string()), "code": pa.array(list(own), pa.int64()), "n": pa.array(list(own.values()), pa.int64())})

    totals = chosen.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = totals.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "code"))).filter(F.col("rank") <= PROFILE)
    profiles: dict[str, list] = {}
    for r in top.collect():  # PROFILE rows a language
        profiles.setdefault(r.lang, []).append((r.rank, r.code))
    return {lang: [c for _, c in sorted(p)] for lang, p in profiles.items()}


def identified(docs: DataFrame, profiles: dict[str, list[int]], keep: list[str] = (), text: str = "text", results: tuple[str, str, str] = RESULTS) -> DataFrame:
    """The columns keep of docs, then lang_pred, score and rejected under the names of results, of each row."""
    spark = ship(docs.sparkSession)
    held, key = spark.sparkContext.broadcast(profiles), uuid.uuid4().hex
    kept = [(c, f) for c, f in zip(columns(docs), docs.schema.fields) if f.name in keep and f.name.lower() not in {r.lower() for r in results}]
    names = [*(f"c{i}" for i in range(len(kept))), "lang", "score", "rejected"]  # any name of a column would not do in mapInArrow
    kinds = [*(f.dataType for _, f in kept), T.StringType(), T.DoubleType(), T.BooleanType()]

    def predict(batches):
        languages = worker_state(key, lambda: Profiles(held.value))
        for b in batches:
            found = [languages.nearest(profile(t)) if t else ("und", 0.0, True) for t in b.column(0).to_pylist()]
            lang, score, rejected = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names)

    d = docs.select(F.col(text).alias("text"), *(c.alias(n) for (c, _), n in zip(kept, names)))
    out = d.mapInArrow(predict, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]))
    return out.toDF(*(f.name for _, f in kept), *results)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profiles = language_profiles(docs)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "text")
    return identified(d, profiles, ["doc_id", "held_out"]).drop("rejected")
