"""Benchmark decontamination: which benchmark items stand inside which documents, with
DataFrame functions only.

Items and documents are sets of word five-grams (words: runs of letters and digits,
lower case); a text of fewer than five words is one n-gram of all its words. Containment is the share of an item's n-grams that a document has; pairs
of THRESHOLD or more are returned. Items are partitioned by size: those with up to
2**k n-grams have a bottom sketch, the smallest MinHash values of their set, of more
than (1 - THRESHOLD) * 2**k values. A document of enough containment lacks fewer n-grams than
the sketch has, so it holds at least one value of the sketch, however long it is:
the candidates are complete. A partition isn't searched in documents that have fewer n-grams than THRESHOLD of its
smallest possible item. Candidates are verified by exact containment of the n-grams as strings.

Documents stay whole. Only (id, item) pairs that meet in a sketch are shuffled; sketches
and candidate pairs are each broadcast when counted at BROADCAST rows at most. Beyond it, a table of bits of the
sketches' values, of 2**WORD_BITS words whatever their number, is broadcast, and only n-grams whose bit is set are joined by key.

Defined results: null and empty texts have no n-grams and match nothing; every distinct text of an item id that repeats is searched
by itself, and the pair has the result of the text of the highest containment, of those the one with most n-grams; items without an id are searched too
and have the id null; of a document id that repeats, and of documents without an id, the row that shares most counts; ties give one row;
texts of any length are whole; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, few, small, stored

N = 5
THRESHOLD = 0.8
BROADCAST = 500_000
#: Items whose n-grams are broadcast: some KB each.
GRAMS = 20_000
WORD_BITS = 20
WORDS = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-case words; empty for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WORDS), "")


def shingle_hashes(w: str, n: int = N) -> Column:
    """A 64-bit hash of each n-gram of the array column named w, in place."""
    def at(i):
        return F.xxhash64(*[F.get(F.col(w), i + k) for k in range(n)])
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), at)).otherwise(F.array().cast("array<bigint>"))


def shingles(w: str, n: int = N) -> Column:
    """The distinct n-grams as strings."""
    def at(i):
        return F.array_join(F.slice(F.col(w), i + 1, n), " ")
    return F.when(F.size(w) >= n, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - n), at))).otherwise(F.array().cast("array<string>"))


def numbered_items(items: DataFrame) -> DataFrame:
    """key, item_id, text: the distinct texts of each id; stored, so that a key stays."""
    rows = items.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    return stored(rows.select(F.monotonically_increasing_id().alias("key"), "item_id", "text"))


def short_lengths(numbered: DataFrame) -> tuple[int, ...]:
    """The lengths of n-grams that the items need: N and their numbers of words below it."""
    short = numbered.select(F.size(words(F.col("text"))).alias("n")).filter(F.col("n").between(1, N - 1)).distinct()
    return (N, *sorted(r.n for r in short.collect()))


def item_sets(numbered: DataFrame) -> DataFrame:
    """key, item_id, grams, hashes; items without words are left out."""
    def of(make, kind):
        return F.coalesce(F.when(F.size("w") >= N, make("w")), *[F.when(F.size("w") == n, make("w", n)) for n in range(1, N)], F.array().cast(kind))
    w = numbered.select("key", "item_id", words(F.col("text")).alias("w"))
    each = w.select("key", "item_id", of(shingles, "array<string>").alias("grams"), F.array_distinct(of(shingle_hashes, "array<bigint>")).alias("hashes"))
    return each.filter(F.size("grams") > 0)


def sketches(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """hash, key, least: the bottom sketch of each item, its length set by the size partition, and the n-grams that
    a document of enough containment of the partition's smallest item has."""
    k = F.ceil(F.log2(F.size("hashes").cast("double")))
    length = F.floor(F.pow(F.lit(2), k) * (1 - threshold) + 1e-9).cast("int") + 1
    least = F.ceil((F.floor(F.pow(F.lit(2), k - 1)) + 1) * threshold - 1e-9).cast("int")
    bottom = F.slice(F.array_sort("hashes"), 1, length)
    return sets.select("key", F.when(k == 0, 1).otherwise(least).alias("least"), F.explode(bottom).alias("hash"))


def candidates(hashed: DataFrame, index: DataFrame) -> DataFrame:
    """The rows of hashed (row, size, hash) that meet a value of index (hash, key, least): row, key."""
    near = F.col("size") >= F.col("least")
    if few(index, BROADCAST):
        return hashed.join(F.broadcast(index), "hash").filter(near).select("row", "key").distinct()
    word, bit = F.shiftrightunsigned("hash", 64 - WORD_BITS), F.expr("shiftleft(1L, cast(hash & 63 as int))")
    bits = index.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    seen = hashed.withColumn("word", word).join(F.broadcast(bits), "word").filter(F.col("bits").bitwiseAND(bit) != 0)
    return seen.select("row", "size", "hash").distinct().join(index, "hash").filter(near).select("row", "key").distinct()


def found(docs: DataFrame, numbered: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc, key, n_item, n_shared of the pairs of enough containment, from docs (doc, text).

    Rows are known by a hash of their texts, so copies are searched for once and ids may repeat or be null;
    every row is verified by its own text, so hashes that collide do no harm."""
    sets, lengths = item_sets(numbered), short_lengths(numbered)
    def joined(make):
        return F.concat(*[make("w", n) for n in lengths]) if len(lengths) > 1 else make("w", N)
    d = docs.filter("text is not null").withColumn("row", F.xxhash64("text"))
    w = d.select("row", words(F.col("text")).alias("w"))
    # apart from the explode, so that no row drags the words along; outer, or else the planner filters by the array's
    # size before it, with the words cut anew for every n-gram (a row without any joins nothing)
    hashed = w.select("row", F.size("w").alias("size"), joined(shingle_hashes).alias("h")).select("row", "size", F.explode_outer("h").alias("hash"))
    pairs = stored(candidates(hashed, sketches(sets, threshold)))
    # the candidates' whole texts against their items' whole sets; texts move only if the pairs are many
    own = d.join(small(pairs, BROADCAST), "row").select("doc", "key", words(F.col("text")).alias("w")).select("doc", "key", joined(shingles).alias("own"))
    shared = F.size(F.array_intersect("own", "grams")).cast("long")
    both = own.join(small(sets.select("key", "grams"), GRAMS), "key").select("doc", "key", F.size("grams").cast("long").alias("n_item"), shared.alias("n_shared"))
    return both.filter(F.col("n_shared") / F.col("n_item") >= threshold - 1e-12)


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment of the pairs of enough containment."""
    numbered = numbered_items(items)
    pairs = found(docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")), numbered, threshold)
    best = pairs.join(small(numbered.select("key", "item_id"), BROADCAST), "key").groupBy(F.col("doc").alias("doc_id"), "item_id")
    best = best.agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_item", "n_shared")).alias("x"))
    return best.select("doc_id", "item_id", "x.n_item", "x.n_shared", "x.containment")


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc of the documents (doc, text) that contain any text of items (item_id, text)."""
    return found(docs, numbered_items(items)).select("doc").distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


SQL = """
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
bw AS (SELECT row_number() OVER () AS key, item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
lengths AS (SELECT DISTINCT least(len(w), 5) AS k FROM bw WHERE len(w) > 0),
ds AS (SELECT DISTINCT r, doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS g FROM dw, lengths WHERE len(w) >= k),
bs AS (SELECT DISTINCT key, item_id, least(len(w), 5) AS k, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i+least(len(w), 5)-1], ' '))) AS g FROM bw WHERE len(w) > 0),
n AS (SELECT key, count(*) AS n_item FROM bs GROUP BY key),
s AS (SELECT r, doc_id, key, item_id, count(*) AS n_shared FROM ds JOIN bs USING (k, g) GROUP BY ALL),
f AS (SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM s JOIN n USING (key) WHERE n_shared / n_item >= 0.8 - 1e-12)
SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY containment DESC, n_item DESC) = 1
"""
