"""Packing by minimum bin slack.

Documents are cut into full windows and a remainder. The remainders' lengths are
counted over the corpus (WINDOW - 1 counts at most, whatever its size). While some are
left, a subset-sum over bitsets finds the multiset of remaining lengths that fills a
window closest to its capacity and contains the longest one left; how often each length
is used is found by going back through the layers. The pattern is applied as often as the counts allow,
so there are about as many patterns as lengths. Each remainder then gets its number
among those of its length from counts per input partition, and from that its window and offset:
nothing but (partition, length) counts is gathered.

Windows are padded to WINDOW unless their length is a power of two.

Defined results: null text counts as empty, a document then is the end id alone; rows
that repeat are documents of their own; a null id stays null; an empty table gives no
rows; other columns are ignored; a text of any length is cut, so no piece exceeds WINDOW.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, ship, stored
from .units import encoder, same_ids

WINDOW = 2048
END = 1


def best_multiset(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of the lengths, as often as counted, with the largest sum up to capacity.

    Layer k's bit s says that the first k kinds reach the sum s; counts are split into
    powers of two, so a layer is a few shifts, and the way back finds how many were used."""
    kinds = sorted((n for n in counts if n <= capacity), reverse=True)
    mask, reach, layers = (1 << capacity + 1) - 1, 1, []
    for n in kinds:
        left, power = min(counts[n], capacity // n), 1
        while left:
            k = min(power, left)
            layers.append((n, k, reach))
            reach |= (reach << n * k) & mask
            left, power = left - k, power * 2
        if reach >> capacity & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for n, k, before in reversed(layers):
        if not before >> total & 1:
            used[n] = used.get(n, 0) + k
            total -= n * k
    return used


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """[(multiset, times)]: windows that use up the counts."""
    left, out = {n: c for n, c in counts.items() if c}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        used = best_multiset({n: c for n, c in left.items() if c}, window - longest)
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(left[n] // k for n, k in used.items())
        out.append((used, times))
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


def slots(patterns: list[tuple[dict[int, int], int]]) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """By length: (first number, numbers in all, numbers in a window, first window, offset in it) of each pattern."""
    out: dict[int, list] = {}
    seen: dict[int, int] = {}
    window = 0
    for used, times in patterns:
        offset = 0
        for n in sorted(used, reverse=True):
            k = used[n]
            out.setdefault(n, []).append((seen.get(n, 0), k * times, k, window, offset))
            seen[n] = seen.get(n, 0) + k * times
            offset += n * k
        window += times
    return out


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """part, row, doc_id, doc_tokens, start, length, ids_crc32, nth: the pieces of each row; nth counts,
    within part, those of a length below the window, and the full ones."""
    ship(docs.sparkSession)
    fast = same_ids(tokenizer)
    names = ["part", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth"]

    def cut(batches):
        from pyspark import TaskContext

        part, cache, seen = TaskContext.get().partitionId(), encoder(tokenizer, fast), np.zeros(window + 1, np.int64).tolist()
        end = np.array([END], "<u4").tobytes()
        for b in batches:
            texts, ids = [t or "" for t in b.column(1).to_pylist()], b.column(0).to_pylist()
            for at in range(0, len(texts), 1000):
                rows = []
                for key, data in zip(ids[at : at + 1000], cache.encode(texts[at : at + 1000])):
                    data += end
                    n = len(data) // 4
                    for start in range(0, n, window):
                        length = min(window, n - start)
                        rows.append((part, key, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), n, seen[length]))
                        seen[length] += 1
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in zip(names, zip(*rows))})

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return d.mapInArrow(cut, ", ".join(f"{k} long" for k in names))


def packed(docs: DataFrame, tokenizer: str, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece."""
    spark = docs.sparkSession
    p = stored(pieces(docs, tokenizer, window, doc_id, text))
    counts = p.groupBy("part", "length").agg(F.count("*").alias("n"))
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # window rows at most
    full = totals.pop(window, 0)
    patterns = slots(plan(totals, window))
    before = counts.select("part", "length", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    numbered = p.join(before, ["part", "length"])
    place = spark.sparkContext.broadcast({n: [np.array(x) for x in zip(*v)] for n, v in patterns.items()})

    def put(batches):
        table = place.value
        for b in batches:
            length, number = np.asarray(b.column("length")), np.asarray(b.column("number"))
            window_of, offset = np.array(number), np.zeros(len(number), np.int64)
            for n in np.unique(length).tolist():
                if n < window:
                    at = np.flatnonzero(length == n)
                    first, _, k, base, start = table[n]
                    i = np.searchsorted(first, number[at], "right") - 1
                    rank = number[at] - first[i]
                    window_of[at] = full + base[i] + rank // k[i]
                    offset[at] = start[i] + rank % k[i] * n
            cols = {c: b.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            yield pa.RecordBatch.from_pydict(cols | {"sequence_id": pa.array(window_of), "offset": pa.array(offset)})

    rows = numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("nth") + F.col("before")).alias("number"))
    return rows.mapInArrow(put, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
