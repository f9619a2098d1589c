"""A small catalog of records: availability, order, pins, filters, custom records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CUSTOM = "[Custom]"


def truthy(flag: Column) -> Column:
    """A flag that is a text: any but the empty one, also `false`. A boolean has to be cast to "boolean" by the caller, who knows."""
    return F.coalesce(flag.cast("string") != "", F.lit(False))


def with_availability(catalog: DataFrame, partial_hosts: list[str], error_hosts: list[str], partial_say: str, error_say: str) -> DataFrame:
    """local, partial, error and say by the first rule that a record meets."""
    any_of = lambda hosts: F.coalesce(F.exists(F.array(*map(F.lit, hosts)), lambda h: F.instr(F.col("link"), h) > 0) if hosts else F.lit(False), F.lit(False))
    rule = F.when(F.array_contains("categories", "local"), "local").when(any_of(partial_hosts), "partial").when(any_of(error_hosts), "error")
    c = catalog.withColumn("_rule", rule)
    part, bad = (F.col("_rule") == "partial") & F.col("partial").isNull(), (F.col("_rule") == "error") & F.col("error").isNull()
    return c.withColumns({"local": F.when(F.col("_rule") == "local", "true").otherwise(F.col("local")), "say": F.when(part, partial_say).when(bad, error_say).otherwise(F.col("say")), "partial": F.when(part, "true").otherwise(F.col("partial")), "error": F.when(bad, "true").otherwise(F.col("error"))}).drop("_rule")


def severity(defaults: dict[str, str]) -> tuple[Column, Column]:
    """Color and message: error before load before partial."""
    level = F.when(truthy(F.col("error")), "red").when(truthy(F.col("load")), "yellow").when(truthy(F.col("partial")), "yellow")
    kind = F.when(truthy(F.col("error")), defaults["error"]).when(truthy(F.col("load")), defaults["load"]).when(truthy(F.col("partial")), defaults["partial"])
    return level, F.coalesce(F.nullif(F.col("say"), F.lit("")), kind)


def action() -> Column:
    """What opening a record does: the first flag set."""
    out = F.lit(None).cast("string")
    for name in reversed(("local", "local2", "blank", "now", "custom", "dy")):
        out = F.when(truthy(F.col(name)), name).otherwise(out)
    return F.coalesce(out, F.lit("default"))


def choice(text: Column, size: Column) -> Column:
    """A 1-based choice from the digits a text begins with; null when out of bounds."""
    n = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int")
    return F.when((n >= 1) & (n <= size), n)


def effective_link(picked: Column) -> Column:
    several = F.coalesce(F.size("links") > 1, F.lit(False))
    return F.when(several, F.try_element_at("links", F.coalesce(choice(picked, F.size("links")), F.lit(2_000_000)))["url"]).otherwise(F.col("link"))


def menu(links: Column) -> Column:
    return F.array_join(F.transform(links, lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x["name"])), "\n")


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """df with its rows' numbers from 0 in an order, without bringing all rows to one task: rows are numbered within
    ranges of the order, and only the ranges' counts are summed up. Equal rows of the order are numbered in any order.
    df is read several times, so bounds of ranges must not depend on the reading, as those of repartitionByRange do
    (its sample differs from plan to plan): they are taken from the rows whose order has the smallest hashes, which
    skews ranges, not numbers, where few values make up most rows."""
    n, each = 2 * max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), 16
    key = F.struct(*[c.alias(f"_order{i}") for i, c in enumerate(order)])
    sample = df.select(key.alias("_key")).orderBy(F.xxhash64("_key"), "_key").limit(each * n)
    bounds = sample.agg(F.sort_array(F.collect_list("_key")).alias("_keys")).select(F.filter("_keys", lambda _, i: i % each == each - 1).alias("_bounds"))
    d = df.withColumn("_key", key).crossJoin(F.broadcast(bounds)).withColumn("_part", F.lit(0))
    for i in reversed(range(n.bit_length())):  # binary search of the number of bounds up to a row
        further = F.get("_bounds", F.col("_part") + ((1 << i) - 1)) <= F.col("_key")
        d = d.withColumn("_part", F.when(further, F.col("_part") + (1 << i)).otherwise(F.col("_part")))
    d = d.drop("_key", "_bounds")
    sizes = d.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per range
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    d = d.withColumn("_row", F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1)
    return d.join(F.broadcast(before), "_part").withColumn(out, F.col("_row") + F.col("_before")).drop("_part", "_row", "_before")


def ordered(catalog: DataFrame, name: str = "name") -> DataFrame:
    """With `ordinal` from 0: custom records first, then by name in locale order."""
    out = numbered(catalog, [~F.col(name).startswith(CUSTOM), F.collate(F.col(name), "UNICODE"), F.col(name)], "ordinal")
    return out.withColumn("ordinal", F.col("ordinal").cast("int"))


def options(df: DataFrame, label: str = "label", seq: str = "seq", collation: str = "UNICODE") -> DataFrame:
    """With `ordinal`: by label in locale order, or that of another collation, equal ones as they came; those without a label, or a seq, last."""
    return numbered(df, [F.col(label).isNull(), F.collate(F.col(label), collation), F.col(seq).isNull(), F.col(seq)], "ordinal")


def parse_pins(text: Column) -> Column:
    """Ordinals of a list in text; what isn't a number is left out."""
    return F.filter(F.transform(F.split(text, ","), lambda p: F.regexp_extract(p, r"^\s*([+-]?\d+)", 1).try_cast("int")), lambda n: n.isNotNull())


def toggle(pins: Column, n: Column) -> Column:
    """Without the first n if it is there, else with n at the end."""
    at = F.array_position(pins, n).cast("int")
    return F.when(at > 0, F.concat(F.slice(pins, 1, at - 1), F.slice(pins, at + 1, F.size(pins)))).otherwise(F.array_append(pins, n))


def pinned(catalog: DataFrame, pins: DataFrame) -> DataFrame:
    """With `is_pinned` and `position`: pinned records first, each part by ordinal; ordinal 0 is never pinned."""
    p = pins.filter("pin <> 0").select(F.col("pin").alias("ordinal")).distinct()
    yes = catalog.join(p, "ordinal", "left_semi").withColumn("is_pinned", F.lit(True))
    no = catalog.join(p, "ordinal", "left_anti").withColumn("is_pinned", F.lit(False))
    out = numbered(yes.unionByName(no), [~F.col("is_pinned"), F.col("ordinal")], "position")
    return out.withColumn("position", F.col("position").cast("int"))


def in_categories(catalog: DataFrame, selected: list[str]) -> DataFrame:
    """Records with any selected category; all when none is selected."""
    return catalog.filter(F.arrays_overlap("categories", F.array(*map(F.lit, selected)))) if selected else catalog


def name_contains(df: DataFrame, text: str, name: str = "name") -> DataFrame:
    return df.filter(F.lower(name).contains(text.lower()))


def custom_records(apps: DataFrame, image: str = "custom.png") -> DataFrame:
    """From (seq, title, link): records, the newest first; both title and link must be there."""
    return apps.filter((F.coalesce("title", F.lit("")) != "") & (F.coalesce("link", F.lit("")) != "")).select((-F.col("seq")).alias("order"), F.concat(F.lit(CUSTOM + " "), "title").alias("name"), "link", F.lit(image).alias("image"), F.lit("true").alias("custom"))


def with_custom(catalog: DataFrame, custom: DataFrame) -> DataFrame:
    """Custom records (newest first) before a catalog that has `ordinal`; `order` sorts both."""
    return custom.unionByName(catalog.withColumn("order", F.col("ordinal").cast("long")), allowMissingColumns=True).withColumn("is_custom", F.col("custom").isNotNull())


def append_apps(apps: DataFrame) -> DataFrame:
    """user, apps after a log of (user, seq, title): each gets the key of its number, so the fold is a map in the order of seq."""
    listed = apps.groupBy("user").agg(F.array_sort(F.collect_list(F.struct("seq", "title"))).alias("x"))
    return listed.select("user", F.map_from_entries(F.transform("x", lambda x, i: F.struct(F.concat(F.lit("custom"), (i + 1).cast("string")), x["title"]))).alias("apps"))


def image_shown(image: Column) -> Column:
    return F.coalesce(image != "", F.lit(False))


def resolved(custom: Column, preset: Column) -> Column:
    """A custom value, or the preset where there is none."""
    return F.coalesce(F.nullif(custom, F.lit("")), preset)


def first_match(items: Column, test) -> Column:
    """The first element that passes, and its index from 0; null and -1 without one."""
    hits = F.transform(items, lambda x: F.coalesce(test(x), F.lit(False)))
    at = F.array_position(hits, True).cast("int") - 1
    return F.struct(F.when(at >= 0, F.get(items, F.greatest(at, F.lit(0)))).alias("item"), at.alias("index"))


def next_key(apps: Column) -> Column:
    """The key that a further entry of a map gets."""
    return F.concat(F.lit("custom"), (F.size(F.map_keys(apps)) + 1).cast("string"))


def move(items: Column, item: Column, target: Column) -> Column:
    """item before the target if it stood after it, else after it; unchanged if either isn't there or is null."""
    def at(where, x):
        return F.coalesce(F.array_position(where, x).cast("int"), F.lit(0))
    i, j = at(items, item), at(items, target)
    rest = F.filter(items, lambda x: x != item)
    before = F.greatest(at(rest, target) - F.when(i > j, 1).otherwise(0), F.lit(0))
    moved = F.concat(F.slice(rest, 1, before), F.array(item), F.slice(rest, before + 1, F.size(rest)))
    return F.when((i == 0) | (j == 0) | (i == j), items).otherwise(moved)
