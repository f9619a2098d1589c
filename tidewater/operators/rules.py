"""Rule tables, routing predicates, stores and hooks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import http, urls


def matched_rules(elements: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (element, attribute, value) that a rule (action, elements, attributes) covers, with its action.

    The rules are unfolded to (element, attribute) first, so the join is one of equal keys."""
    flat = rules.select("action", F.explode("elements").alias("element"), "attributes").select("action", "element", F.explode("attributes").alias("attribute")).distinct()
    return elements.join(flat, ["element", "attribute"])


def attribute_rows(pages: DataFrame, elements: list[str], attributes: list[str]) -> DataFrame:
    """page_id, element, attribute, value of the attributes in quotes of these elements' tags."""
    tags = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(rf"(?i)<((?:{'|'.join(elements)})\b[^>]*)>"), F.lit(1))).alias("tag"))
    rows = tags.select("page_id", F.lower(F.regexp_extract("tag", r"^(\w+)", 1)).alias("element"), F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.regexp_extract("tag", rf'\s{a}="([^"]*)"', 1).alias("value"), F.col("tag").rlike(rf'\s{a}="').alias("there")) for a in attributes])).alias("x"))
    return rows.filter("x.there").select("page_id", "element", "x.attribute", "x.value")


def frames_of(tabs: DataFrame, frames: DataFrame) -> DataFrame:
    """Tabs with the frame of their id."""
    return tabs.join(frames, "tab_id")


def dynamic_route(path: Column, client: Column, prefix: str, transport: str) -> Column:
    """Not the transport's path, and under the prefix itself or asked for by a client that is."""
    return ~path.startswith(transport) & (path.startswith(prefix) | F.coalesce(client.startswith(prefix), F.lit(False)))


def visible_names(names: Column, hidden: list[str]) -> Column:
    """Names without the hidden ones; repeats stay."""
    return F.filter(names, lambda n: ~n.isin(hidden)) if hidden else names


def stored_rows(store: DataFrame, key: str | None = None, value: str | None = None) -> DataFrame:
    """Rows of a key, of an indexed value, or all."""
    out = store if key is None else store.filter(F.col("key") == key)
    return out if value is None else out.filter(F.col("value") == value)


def cleared(store: DataFrame) -> DataFrame:
    return store.limit(0)


def ok_only(responses: DataFrame) -> DataFrame:
    """Responses whose status is of the 2xx kind."""
    return responses.filter((F.col("status") >= 200) & (F.col("status") < 300))


def keys_of(store: DataFrame, key: str | None = None) -> DataFrame:
    return stored_rows(store, key).select("key")


def open_store(spark, path: str) -> DataFrame:
    """The store (key, value) in a folder, made empty where it isn't there yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        spark.createDataFrame([], "key string, value string").write.parquet(path)
    return spark.read.schema("key string, value string").parquet(path)


def hooked(df: DataFrame, hooks: list[Callable[[DataFrame], DataFrame | None]], first_only: bool = False) -> DataFrame:
    """df through hooks in order; one that returns None leaves it as it is. With first_only only the first registered one is asked."""
    for h in hooks[:1] if first_only else hooks:
        out = h(df)
        if out is not None:
            df = out
    return df


CODECS: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]] = {
    "none": (lambda c: c, lambda c: c),
    "plain": (urls.uri_encode, urls.uri_decode),
    "xor": (urls.xor_encode, urls.xor_decode),
    "base64": (http.base64_latin1, http.base64_text),
}


def codec(name: str) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """Encoder and decoder by name; add to CODECS for one's own."""
    return CODECS[name]
