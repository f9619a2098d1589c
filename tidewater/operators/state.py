"""Keyed state folded over ordered events, in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ttl_cache(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """key, hits, misses of a cache whose entries expire seconds after they were stored, not after
    they were read. A null time is no event.

    Events are range-partitioned by key and time, so the events of a frequent key lie in several
    blocks. An entry that a block begins with expires at one of the block's first events, those
    within the time to live of its first one; for each of these, alike neighbours together, a block tells the
    entry it ends with and its misses. Blocks of a key are then applied in order, one at a time."""
    ttl, kind = seconds * 1_000_000, events.schema[key].dataType.simpleString()

    def blocks(batches):
        from itertools import groupby

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        block = TaskContext.get().partitionId()

        def summary(k, parts):
            t = np.concatenate(parts)
            m = len(t)
            # following the chain of stored entries from every event, in doubled steps
            after = np.append(np.searchsorted(t, t + ttl, "right"), m)
            last, misses = np.arange(m + 1), np.append(np.ones(m, np.int64), 0)
            while (live := np.flatnonzero(after < m)).size:
                to = after[live]
                misses[live], last[live], after[live] = misses[live] + misses[to], last[to], after[to]
            n = min(int(np.searchsorted(t, t[0] + ttl, "right")) + 1, m) if m else 0
            last, misses = last[:n], misses[:n]
            ends = np.flatnonzero(np.append((last[1:] != last[:-1]) | (misses[1:] != misses[:-1]), True)) if n else last
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (t[ends], t[last[ends]], misses[ends])]
            return pa.RecordBatch.from_arrays([pa.array([k], field), pa.array([block], pa.int32()), pa.array([m], pa.int64()), *lists], ["_k", "_b", "n", "upto", "stored", "misses"])

        now, parts, field = None, [], None
        for b in batches:
            field, at = b.column(0).type, 0
            for k, run in groupby(b.column(0).to_pylist()):
                size = sum(1 for _ in run)
                if parts and k != now:
                    yield summary(now, parts)
                    parts = []
                now = k
                parts.append(b.column(1).slice(at, size).drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
                at += size
        if parts:
            yield summary(now, parts)

    def applied(batches):
        import numpy as np
        import pyarrow as pa

        now, field, state = None, None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([now], field), pa.array([state[1]], pa.int64()), pa.array([state[2]], pa.int64())], [key, "hits", "misses"])

        for b in batches:
            field = b.column(0).type
            for i, k in enumerate(b.column(0).to_pylist()):
                if state is not None and k != now:
                    yield row()
                    state = None
                now, (at, hits, missed) = k, state or (None, 0, 0)
                n, (upto, stored, misses) = b.column(2)[i].as_py(), (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (3, 4, 5))
                j = 0 if at is None else int(np.searchsorted(upto, at + ttl, "right"))
                new = int(misses[j]) if j < len(upto) else 0
                state = (int(stored[j]) if new else at, hits + n - new, missed + new)
        if state is not None:
            yield row()

    t = F.unix_micros(F.col(ts).cast("timestamp"))
    e = events.select(F.col(key).alias("_k"), t.alias("_t")).repartitionByRange("_k", "_t").sortWithinPartitions("_k", "_t")
    made = e.mapInArrow(blocks, f"_k {kind}, _b int, n long, upto array<long>, stored array<long>, misses array<long>")
    return made.repartition("_k").sortWithinPartitions("_k", "_b").mapInArrow(applied, f"{key} {kind}, hits long, misses long")


def automaton(wanted: list[str]) -> tuple[list[str], list[list[int]]]:
    """Symbols and, by the length of the wanted prefix that the last values are, the next one for
    any other value and for each symbol; the full length stands for a match."""
    symbols = sorted(set(wanted))
    def after(s, c):
        last = [*wanted[:s], c]
        return max(k for k in range(len(last) + 1) if last[len(last) - k :] == wanted[:k])
    return symbols, [[0, *(after(s, c) for c in symbols)] for s in range(len(wanted))]


def sequence_matches(events: DataFrame, key: str, order: list[str], value: str, wanted: list[str]) -> DataFrame:
    """key, matches: how often the last values were the wanted ones; a match starts anew.

    Events are range-partitioned by key and order, so the events of a frequent key lie in several
    blocks. A block is what it makes of each state of the wanted sequence's automaton; a key's blocks are applied in order."""
    symbols, steps = automaton(wanted)
    n = len(wanted)
    table = F.array(*[F.array(*map(F.lit, row)) for row in steps])
    code = F.coalesce(F.array_position(F.array(*map(F.lit, symbols)), F.col(value)), F.lit(0)).cast("int")
    e = events.select(F.col(key).alias("_k"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], code.alias("_c")).repartitionByRange("_k", *[f"_o{i}" for i in range(len(order))])
    blocks = e.withColumn("_b", F.spark_partition_id()).groupBy("_k", "_b").agg(F.array_sort(F.collect_list(F.struct(*[f"_o{i}" for i in range(len(order))], "_c"))).alias("x"))
    begin = F.array(*[F.struct(F.lit(s).alias("at"), F.lit(0).cast("long").alias("n")) for s in range(n)])
    def one(a, x):
        to = F.get(F.get(table, a["at"]), x["_c"])
        return F.struct(F.when(to == n, 0).otherwise(to).alias("at"), (a["n"] + (to == n).cast("long")).alias("n"))
    made = blocks.select("_k", "_b", F.aggregate("x", begin, lambda a, x: F.transform(a, lambda s: one(s, x))).alias("f"))
    whole = made.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_b", "f"))).alias("x"))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("n"))
    def then(a, x):
        f = F.get(x["f"], a["at"])
        return F.struct(f["at"].alias("at"), (a["n"] + f["n"]).alias("n"))
    return whole.select(F.col("_k").alias(key), F.aggregate("x", zero, then)["n"].alias("matches"))


def last_n(events: DataFrame, key: str, order: list[str], value: str, n: int) -> DataFrame:
    """key, last: the last n values in order. Ranks come first, so that tasks keep n rows a key and no history is gathered."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(*[F.col(o).desc() for o in order]))
    top = events.select(key, *order, F.col(value).alias("_v"), rank.alias("_r")).filter(F.col("_r") <= n)
    return top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("r"), "_v"))), lambda x: x["_v"]).alias("last"))


def buffers(events: DataFrame, key: str, order: list[str], value: str, n: int) -> DataFrame:
    """events with `buffer`: the last n values at each event."""
    return events.withColumn("buffer", F.collect_list(value).over(W.partitionBy(key).orderBy(*order).rowsBetween(-(n - 1), 0)))


def cookie_jar(ops: DataFrame, now: str) -> DataFrame:
    """host, name, value, expires after a log (seq, host, domain, name, value, expires): stored under the
    domain without its dot, or the host; the last write counts; one that had expired by then deletes."""
    at = F.ltrim(F.coalesce(F.nullif("domain", F.lit("")), "host"), F.lit("."))
    last = ops.select(at.alias("host"), "name", "seq", "value", "expires").groupBy("host", "name").agg(F.max(F.struct("seq", "value", "expires")).alias("x"))
    kept = last.filter(F.col("x.expires").isNull() | (F.col("x.expires") > F.to_timestamp(F.lit(now))))
    return kept.select("host", "name", "x.value", "x.expires")


def tabs(events: DataFrame) -> DataFrame:
    """session, tabs, active after (session, seq, action, tab_id, target_id): create appends and shows,
    switch shows, close removes and shows the first one left if it was shown, reorder moves before or after the target."""
    from .catalog import move

    g = events.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("seq", "action", "tab_id", "target_id"))).alias("e"))
    zero = F.struct(F.array().cast("array<string>").alias("tabs"), F.lit(None).cast("string").alias("active"))
    def step(a, e):
        there = F.array_contains(a["tabs"], e["tab_id"])
        left = F.filter(a["tabs"], lambda t: t != e["tab_id"])
        return (
            F.when((e["action"] == "create") & ~there, F.struct(F.array_append(a["tabs"], e["tab_id"]).alias("tabs"), e["tab_id"].alias("active")))
            .when((e["action"] == "switch") & there, F.struct(a["tabs"].alias("tabs"), e["tab_id"].alias("active")))
            .when((e["action"] == "close") & there, F.struct(left.alias("tabs"), F.when(a["active"] == e["tab_id"], F.get(left, 0)).otherwise(a["active"]).alias("active")))
            .when((e["action"] == "reorder") & there, F.struct(move(a["tabs"], e["tab_id"], e["target_id"]).alias("tabs"), a["active"].alias("active")))
            .otherwise(a)
        )
    return g.select("session", F.aggregate("e", zero, step).alias("x")).select("session", "x.tabs", "x.active")


def tab_source(first, one_shot, address, prefix: str):
    """The address that a tab opens: the first tab the stored one, later ones a one-shot address before it."""
    raw = F.when(first, address).otherwise(F.coalesce(F.nullif(one_shot, F.lit("")), address))
    raw = F.nullif(raw, F.lit(""))
    return F.when(raw.isNull(), "/").when(raw.contains("/e/"), raw).otherwise(F.concat(F.lit(prefix), raw))


def tab_title(title):
    return F.when(F.coalesce(F.length(title), F.lit(0)) <= 1, "Tab").otherwise(title)
