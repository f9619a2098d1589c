"""Dictionary lookups as joins, key-value logs, best rows by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(df: DataFrame, dim: DataFrame, key: str, how: str = "left", default: dict | None = None) -> DataFrame:
    """df with the columns of a dictionary; Spark decides how to join. Defaults fill what is missing."""
    out = df.join(dim, key, how)
    return out.fillna(default) if default else out


def mapped(value: Column, table: dict[str, str], default: str | None = None) -> Column:
    """A settings value by a literal map."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, value), F.lit(default))


def by_prefix(df: DataFrame, column: str, prefixes: dict[str, str], out: str) -> DataFrame:
    """The value of the first prefix that a column starts with; a ladder, so no join."""
    c = F.lit(None).cast("string")
    for p, v in reversed(prefixes.items()):
        c = F.when(F.col(column).startswith(p), v).otherwise(c)
    return df.withColumn(out, c)


def blocked(host: Column, hosts: list[str], patterns: list[str]) -> Column:
    """Exact host, or any pattern."""
    out = host.isin(hosts) if hosts else F.lit(False)
    for p in patterns:
        out = out | host.rlike(p)
    return out


def last_write(log: DataFrame) -> DataFrame:
    """key, value of a log of (seq, key, value); a null value deletes."""
    last = log.groupBy("key").agg(F.max(F.struct("seq", "value")).alias("x"))
    return last.filter("x.value is not null").select("key", F.col("x.value").alias("value"))


def add_absent(store: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new whose key isn't there yet (one a key, the smallest value), and the store."""
    once = new.groupBy("key").agg(F.min("value").alias("value"))
    return store.select("key", "value").unionByName(once.join(store, "key", "left_anti"))


def put(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store with the rows (key, value) of new over it."""
    return new.select("key", "value").unionByName(store.select("key", "value").join(new, "key", "left_anti"))


def deleted(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys, "key", "left_anti")


def namespaced(prefix: str, origin: Column, key: Column) -> Column:
    return F.concat(F.lit(prefix), origin, F.lit("@"), key)


def host_key(prefix: str, host: Column, key: Column) -> Column:
    return F.concat(F.lit(prefix + "$"), host, F.lit("$"), key)


def namespace_keys(store: DataFrame, prefix: str) -> DataFrame:
    """The keys of a namespace without it, with their ordinal in the order of seq."""
    from .catalog import numbered

    own = store.filter(F.col("key").startswith(prefix))
    return numbered(own, [F.col("seq"), F.col("key")], "nth").select(F.substring("key", len(prefix) + 1, 1 << 30).alias("key"), "nth")


def reversed_table(table: dict[str, str]) -> dict[str, str]:
    """From stored values back to settings; of values that repeat the first setting counts."""
    return {v: k for k, v in reversed(table.items())}


def best_by_extension(types: DataFrame) -> DataFrame:
    """extension, type, charset: types in the order of their ordinal; each replaces the one before it, unless that has a source of a
    higher rank, or is an application/ type of the same rank. application/octet-stream always gives way.
    A media type's dictionary has few types an extension, so each is folded in one array."""
    rank = F.when(F.col("source") == "iana", 3).when(F.col("source").isNull(), 2).when(F.col("source") == "apache", 1).otherwise(0)
    charset = F.col("charset") if "charset" in types.columns else F.lit(None).cast("string")
    rows = types.select(F.explode("extensions").alias("extension"), F.struct("ordinal", "type", rank.alias("rank"), charset.alias("charset")).alias("x"))
    folded = rows.groupBy("extension").agg(F.array_sort(F.collect_list("x")).alias("x"))
    def step(now, new):
        stays = (now["type"] != "application/octet-stream") & ((now["rank"] > new["rank"]) | ((now["rank"] == new["rank"]) & now["type"].startswith("application/")))
        return F.when(stays, now).otherwise(new)
    best = folded.select("extension", F.aggregate(F.slice("x", 2, F.size("x")), F.get("x", 0), step).alias("x"))
    return best.select("extension", "x.type", "x.charset")


def content_types(paths: DataFrame, types: DataFrame, path: str = "path", overrides: dict[str, str] | None = None) -> DataFrame:
    """paths with `content_type`: by extension, with a charset (that of the type, or UTF-8 for text); null for an unknown one."""
    from ..functions.http import extension

    best = best_by_extension(types).select(F.col("extension").alias("_extension"), "type", "charset")
    charset = F.lower(F.coalesce("charset", F.when(F.col("type").startswith("text/"), "utf-8")))
    full = F.when(F.col("type").contains("charset") | charset.isNull(), F.col("type")).otherwise(F.concat("type", F.lit("; charset="), charset))
    out = paths.withColumn("_extension", extension(F.col(path))).join(best, "_extension", "left")
    own = mapped(F.col("_extension"), overrides) if overrides else F.lit(None).cast("string")
    return out.withColumn("content_type", F.coalesce(own, full)).drop("_extension", "type", "charset")


def with_parent_cookies(cookies: DataFrame, parent: Column) -> DataFrame:
    """A host's cookies and those of its parent domain that it hasn't with the same name and value."""
    own = cookies.select("host", "name", "value")
    up = cookies.select(F.col("host").alias("p"), "name", "value")
    hosts = own.select("host").distinct().withColumn("p", parent).filter("host <> p")
    more = hosts.join(up, "p").select("host", "name", "value").join(own, ["host", "name", "value"], "left_anti")
    return own.unionByName(more)


def pick(items: list[str], draw: Column) -> Column:
    """An element by a number from 0 to 1; F.rand() for a random one."""
    return F.element_at(F.array(*map(F.lit, items)), F.floor(draw * len(items)).cast("int") + 1)


def next_index(i: Column, n: int) -> Column:
    return F.pmod(i + 1, F.lit(n))
