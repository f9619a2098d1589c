"""Token counts of whole texts by a two-tier lookup, without shuffling pre-tokens.

Tier 1 is a broadcast table of the corpus' frequent pre-tokens and their lengths in
tokens, of at most TABLE entries of at most UNIT_BYTES bytes. It comes from a bounded
frequent-items summary of each input partition (all rows are counted), merged in a
tree; only those summaries move. Tier 2 is a cache in each Python worker, filled by
encoding the units that a chunk of texts needs and neither tier has. Which units are
in a tier changes the speed, never a count.

Defined results: null text counts as empty (0 bytes, 0 tokens); rows are independent,
so repeated rows and ties give a row each; an empty table gives no rows; columns other
than doc_id and text are never read; texts with runs of spaces, leading or trailing
spaces, or the model's own space mark are encoded whole by the library.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import units
from .common import chunks, documents, ship, worker_state

TABLE = 32_768
UNIT_BYTES = 64
PART_ENTRIES = 4_096
HELD = 200_000
MARK = "▁"


def _pack(counts: list[tuple[str, int]]) -> bytes:
    blob = [u.encode() for u, _ in counts]
    sizes = np.array([len(b) for b in blob], "<u1").tobytes()
    return len(blob).to_bytes(4, "little") + sizes + np.array([n for _, n in counts], "<i8").tobytes() + b"".join(blob)


def _unpack(data: bytes) -> dict[str, int]:
    n = int.from_bytes(data[:4], "little")
    ends = np.cumsum(np.frombuffer(data, "<u1", n, 4).astype(np.int64)) + 4 + 9 * n
    starts = np.concatenate([[4 + 9 * n], ends[:-1]]) if n else ends
    counts = np.frombuffer(data, "<i8", n, 4 + n).tolist()
    return {data[a:b].decode(): c for a, b, c in zip(starts.tolist(), ends.tolist(), counts)}


class Tiers(dict):
    """Tier 1 as a table; what it lacks is looked up in tier 2, the worker's cache."""

    def __init__(self, table: dict[str, int]):
        super().__init__(table)
        self.second: dict[str, int] = {}

    def __missing__(self, unit: str) -> int:
        return self.second[unit]


def _top(counts: Counter, most: int) -> list[tuple[str, int]]:
    return sorted(((u, n) for u, n in counts.items() if 0 < len(u.encode()) <= UNIT_BYTES), key=lambda x: (-x[1], x[0]))[:most]


def _summaries(batches):
    counts: Counter = Counter()
    for b in batches:
        for t in b.column(0).to_pylist():
            if t:
                counts.update(t.split(" "))
            if len(counts) > HELD:  # lossy counting: what is rare so far gives way
                counts = Counter(dict(counts.most_common(HELD // 2)))
    yield pa.RecordBatch.from_pydict({"summary": pa.array([_pack(_top(counts, PART_ENTRIES))], pa.binary())})


def _merge(batches):
    counts: Counter = Counter()
    for b in batches:
        for s in b.column(0).to_pylist():
            counts.update(_unpack(s))
    yield pa.RecordBatch.from_pydict({"summary": pa.array([_pack(_top(counts, TABLE))], pa.binary())})


def frequent_units(docs: DataFrame, text: str = "text") -> list[str]:
    """The corpus' most frequent pre-tokens, TABLE at most."""
    found = docs.select(F.col(text).alias("text")).mapInArrow(_summaries, "summary binary")
    n = docs.rdd.getNumPartitions()
    while n > 32:
        n = -(-n // 32)
        found = found.repartition(n).mapInArrow(_merge, "summary binary")
    counts: Counter = Counter()
    for row in found.collect():
        counts.update(_unpack(bytes(row.summary)))
    return [u for u, _ in _top(counts, TABLE)]


def token_counts(docs: DataFrame, model: str, limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs, by the .model file."""
    spark = ship(docs.sparkSession)
    frequent = frequent_units(docs, text)
    lengths = [len(x) for x in units.pieces(model).encode(frequent, num_threads=1)] if frequent else []
    table = spark.sparkContext.broadcast(_pack(list(zip(frequent, lengths))))
    key = f"counts-{uuid.uuid4().hex}"

    def count(batches):
        sp = units.pieces(model)
        tiers = worker_state(key, lambda: Tiers(_unpack(table.value)))
        second, get = tiers.second, tiers.__getitem__
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n_bytes, n_tokens = [len(t.encode("utf-8")) for t in texts], []
            for start, end in chunks(texts):
                cut, need = [], set()
                for t in texts[start:end]:
                    u = t.split(" ")
                    if MARK in t or "" in u:
                        cut.append(t)
                    else:
                        cut.append(u)
                        need.update(u)
                new = list(need.difference(tiers).difference(second))
                for i in range(0, len(new), 20_000):
                    part = new[i : i + 20_000]
                    second.update(zip(part, map(len, sp.encode(part, num_threads=1))))
                n_tokens += [len(sp.encode(c, num_threads=1)) if isinstance(c, str) else sum(map(get, c)) for c in cut]
                if len(second) > units.WORKER_UNITS:
                    second.clear()
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_bytes": pa.array(n_bytes, pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64()), "over_limit": pa.array([n > limit for n in n_tokens], pa.bool_())})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
