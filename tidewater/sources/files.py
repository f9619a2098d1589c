"""Catalog and save files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG = "name string, categories array<string>, image string, link string, links array<struct<name:string,url:string>>, error string, partial string, load string, say string, blank string, now string, dy string, custom string, local string, local2 string"
SAVE = "cookies map<string,string>, localStorage map<string,string>"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON array, with a fixed schema; flags that may be boolean or text are read as text."""
    return spark.read.option("multiLine", True).schema(CATALOG).json(path)


def catalog_path(page: str, paths: dict[str, str], default: str) -> str:
    """The one file that a page reads."""
    return paths.get(page, default)


def save_text(cookies: Column, storage: Column) -> Column:
    """A save file: two maps as pretty JSON."""
    return F.to_json(F.struct(cookies.alias("cookies"), storage.alias("localStorage")), {"pretty": "true"})


def load_save(text: Column, cookies: Column, storage: Column) -> tuple[Column, Column]:
    """Both maps with what the file has put over them; null text changes nothing."""
    s = F.from_json(text, SAVE)
    def over(old, new):
        new = F.coalesce(new, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
        return F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)
    return over(cookies, s["cookies"]), over(storage, s["localStorage"])
