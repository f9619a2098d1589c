"""The batch folds of operators.state as stateful streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ttl_cache(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """key, hits, misses after each micro-batch, from a stream of (key, ts); late events count as they come."""

    def update(k, frames, state):
        at, hits, misses = state.get if state.exists else (None, 0, 0)
        import pandas as pd

        for t in sorted(t for f in frames for t in f["t"].tolist()):
            if at is not None and t - at <= seconds * 1_000_000:
                hits += 1
            else:
                at, misses = t, misses + 1
        state.update((at, hits, misses))
        yield pd.DataFrame({key: [k[0]], "hits": [hits], "misses": [misses]})

    e = events.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    kind = e.schema[key].dataType.simpleString()
    return e.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, hits long, misses long", "at long, hits long, misses long", "update", "NoTimeout")


def folded(events: DataFrame, key: str, order: str, columns: list[str], start, step, rows, out: str) -> DataFrame:
    """A fold as a stream: of each key the state (JSON of what start() gives) goes through step(state, row) for the rows of a
    micro-batch in order, then rows(state) are given as columns `out`. Nulls and any character may stand in values."""

    def update(k, frames, state):
        import json

        import pandas as pd

        now = json.loads(state.get[0]) if state.exists else start()
        new = pd.concat(list(frames)).sort_values("_o", kind="stable")
        for row in new[columns].astype(object).where(new[columns].notna(), None).itertuples(index=False, name=None):
            now = step(now, row)
        state.update((json.dumps(now),))
        yield pd.DataFrame([(k[0], *r) for r in rows(now)], columns=[key, *(c.split()[0] for c in out.split(", "))])

    e = events.select(F.col(key), F.col(order).alias("_o"), *[F.col(c) for c in columns])
    kind = e.schema[key].dataType.simpleString()
    return e.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, {out}", "state string", "update", "NoTimeout")


def sequence_matches(events: DataFrame, key: str, order: str, value: str, wanted: list[str]) -> DataFrame:
    """key, matches after each micro-batch."""

    def step(now, row):
        last = [*now[0], row[0]][-len(wanted) :]
        return [[], now[1] + 1] if last == wanted else [last, now[1]]

    return folded(events, key, order, [value], lambda: [[], 0], step, lambda now: [(now[1],)], "matches long")


def cookie_jar(ops: DataFrame, now: str) -> DataFrame:
    """host, cookies (`name=value` by name) after each micro-batch of (seq, host, domain, name, value, expires), as operators.state.cookie_jar."""

    def step(jar, row):
        name, value, alive = row
        jar.pop(name, None)
        return jar | {name: value} if alive else jar

    at = F.ltrim(F.coalesce(F.nullif("domain", F.lit("")), "host"), F.lit("."))
    alive = F.col("expires").isNull() | (F.col("expires") > F.to_timestamp(F.lit(now)))
    e = ops.select(at.alias("host"), "seq", "name", "value", alive.alias("alive"))
    return folded(e, "host", "seq", ["name", "value", "alive"], dict, step, lambda jar: [("; ".join(f"{k}={v}" for k, v in sorted(jar.items())),)], "cookies string")


def tabs(events: DataFrame) -> DataFrame:
    """session, tabs (joined by commas), active after each micro-batch of (session, seq, action, tab_id, target_id), as operators.state.tabs."""

    def step(now, row):
        (items, active), (action, tab, target) = now, row
        if action == "create" and tab not in items:
            return [[*items, tab], tab]
        if tab not in items:
            return now
        rest = [t for t in items if t != tab]
        if action == "switch":
            return [items, tab]
        if action == "close":
            return [rest, (rest[0] if rest else None) if active == tab else active]
        if action == "reorder" and target in rest:
            k = rest.index(target) + (items.index(tab) < items.index(target))
            return [[*rest[:k], tab, *rest[k:]], active]
        return now

    return folded(events, "session", "seq", ["action", "tab_id", "target_id"], lambda: [[], None], step, lambda now: [(",".join(now[0]), now[1])], "tabs string, active string")
