"""Near-duplicates by ProbMinHash, banding and exact verification.

A document is a set of word five-grams; all weigh 1, however often they stand there, so candidates,
the estimate and the verification are of one similarity. ProbMinHash gives every element a Poisson process whose rate is its
weight; arrivals fall on random components of the signature, the earliest wins. Elements
whose next arrival is later than all components' winners are done (early termination),
so a signature costs little more than one pass. Two signatures agree on a share of
components that estimates the probability Jaccard similarity, here that of the sets.

Steps: texts with equal words are one node (pre-aggregated by a digest). Nodes meet in
buckets, one for each of BANDS bands of ROWS components; a pair of similarity 0.8 misses all of them
with probability 2e-5. In a bucket, each node is compared with a central one (the
node that meets most others) and with one by hash; buckets of SMALL nodes at most
also compare all their pairs. Larger ones whose nodes aren't all in one component by then
are dealt into blocks, and pairs of blocks compare all pairs of their nodes that are in
different components, each pair in the first bucket that it shares. A task emits the links
that connect something new, so no bucket emits all its pairs, and a group, however large, spreads over
tasks. Pairs whose sizes exclude 0.8, or whose signatures are six standard deviations
below it, are dropped, the rest verified exactly: the Jaccard similarity
of the sets of five-grams is at least 0.8. Classes are the connected components of
verified pairs; pairs within a class that star comparisons already found are not verified again.

Defined results: texts of one to four words are one n-gram; texts without words are
compared by their bytes; a null text is a class of its own; rows that repeat an id are
one document, its texts' classes then are one; rows without an id get null;
the class id is the smallest doc_id in the class; an empty table gives no rows;
other columns are ignored; texts of any length are whole.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop, ship, stored, worker_state

N = 5
BANDS, ROWS = 28, 5
SIZE = BANDS * ROWS
SMALL = 12
BLOCK, BLOCK_GRAMS = 256, 200_000
ESTIMATE = 0.58
UNITS = 100_000
WORD = re.compile(r"[^\W_]+")
_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer (SplitMix64's finalizer)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def word_codes(text: str) -> np.ndarray:
    """64-bit codes of the words (runs of letters and digits, lower case) of a text."""
    import xxhash

    cache = worker_state("word codes", dict)
    if len(cache) > UNITS:
        cache.clear()
    units = text.split(" ")
    for u in set(units).difference(cache):
        cache[u] = b"".join(xxhash.xxh64_digest(w.encode()) for w in WORD.findall(u.lower()))
    return np.frombuffer(b"".join(map(cache.__getitem__, units)), ">u8").astype(np.uint64)


def grams(codes: np.ndarray) -> np.ndarray:
    """The hashes of the five-grams, in place; one of all words if there are fewer than five."""
    n = min(N, len(codes))
    if not n:
        return codes
    h = np.full(len(codes) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = mix(h * _GOLD + codes[k : k + len(h)])
    return h


def signature(elements: np.ndarray, weights: np.ndarray, size: int = SIZE) -> np.ndarray:
    """ProbMinHash of a weighted set; elements are distinct 64-bit hashes."""
    winner, at = np.zeros(size, np.uint64), np.full(size, np.inf)
    live, time, count = np.arange(len(elements)), np.zeros(len(elements)), 0
    step = max(1, -(-1300 * size // 140 // len(elements)))
    while len(live):
        turn = np.arange(count + 1, count + step + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            u = mix(elements[live][:, None] + turn * _GOLD)
        gap = -np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        arrival = time[live][:, None] + np.cumsum(gap, 1) / weights[live][:, None]
        place = ((mix(u) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        early = np.flatnonzero((arrival < at[place]).ravel())
        a, p = arrival.ravel()[early], place.ravel()[early]
        order = np.argsort(-a, kind="stable")  # of equal places the last, the earliest arrival, stays
        at[p[order]] = a[order]
        winner[p[order]] = elements[live][early[order] // step]
        time[live] = arrival[:, -1]
        count += step
        live = live[time[live] < at.max()]
        step = max(1, min(step, 256))
    return winner


def band_hashes(sig: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            h = mix(h * _GOLD + sig.reshape(BANDS, ROWS)[:, k])
    return h.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, key (a digest of the words), n (distinct five-grams), bands, sketch of each row with an id."""

    def make(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i in range(0, len(ids), 500):
                key, n, bands, sketch = [], [], [], []
                for d, t in zip(ids[i : i + 500], texts[i : i + 500]):
                    codes = word_codes(t or "")
                    if not len(codes):
                        key.append(f"null {d}" if t is None else hashlib.md5(b"raw " + t.encode()).hexdigest())
                        n.append(0), bands.append([]), sketch.append(b"")
                        continue
                    g = np.unique(grams(codes))
                    sig = signature(g, np.ones(len(g)))
                    key.append(hashlib.md5(codes.tobytes()).hexdigest())
                    n.append(len(g)), bands.append(band_hashes(sig)), sketch.append((sig & np.uint64(0xFFFF)).astype("<u2").tobytes())
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[i : i + 500], pa.int64()), "key": pa.array(key, pa.string()), "n": pa.array(n, pa.int64()), "bands": pa.array(bands, pa.list_(pa.int64())), "sketch": pa.array(sketch, pa.binary())})

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    return d.mapInArrow(make, "doc_id long, key string, n long, bands array<long>, sketch binary")


def compared(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From (bucket, node): the pairs (a, b) of star comparisons, all pairs of small buckets,
    and the (bucket, node) rows of the others."""
    sizes = stored(rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"))
    met = stored(rows.join(sizes, "bucket"))
    degree = met.groupBy("node").agg(F.sum("size").alias("degree"))
    pivots = met.join(degree, "node").groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("node")).alias("x"))).alias("m"), F.max(F.struct(F.xxhash64("node", "bucket").alias("h"), F.col("node").alias("x"))).alias("r"))
    pivots = stored(pivots.select("bucket", (-F.col("m.x")).alias("m"), F.col("r.x").alias("r")))
    star = met.join(pivots, "bucket").select("node", F.explode(F.array("m", "r")).alias("pivot"))
    few = met.filter(F.col("size") <= SMALL).select("bucket", "node")
    small = few.join(few.select("bucket", F.col("node").alias("pivot")), "bucket").select("node", "pivot")
    pair = lambda d: d.filter("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    return pair(star), pair(small), met.filter(F.col("size") > SMALL).select("bucket", "node")


def plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Without the pairs whose sizes exclude a similarity of 0.8, or whose signatures all but do."""

    def agree(batches):
        for b in batches:
            x, y = ([np.frombuffer(s, "<u2") for s in b.column(c).to_pylist()] for c in ("sa", "sb"))
            same = (np.array(x) == np.array(y)).mean(1) >= ESTIMATE if len(x) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(same)), b.column("b").filter(pa.array(same))], ["a", "b"])

    own = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    near = pairs.join(own("a"), "a").join(own("b"), "b").filter("5 * least(na, nb) >= 4 * greatest(na, nb)")
    return near.select("a", "b", "sa", "sb").mapInArrow(agree, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose sets of five-grams have a Jaccard similarity of 0.8 at least; texts: node, text."""

    def check(batches):
        held: dict = {}

        def own(node, text):
            if node not in held:
                if len(held) > 200:
                    held.clear()
                held[node] = np.unique(grams(word_codes(text)))
            return held[node]

        for b in batches:
            keep = []
            for x, y, tx, ty in zip(*(b.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))):
                s, t = own(x, tx), own(y, ty)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(5 * both >= 4 * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    t = texts.join(wanted, "node", "left_semi")
    joined = pairs.join(t.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(t.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return joined.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node that a node is connected to; nodes with edges only.

    Large-star and small-star steps until nothing changes. Each step is written to the shared
    folder, minima too: a join with them can then split the rows of a hub. What a step has used is removed after it."""
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").filter("v <> m").select("v", "m").toDF("u", "v").unionAll(least.toDF("u", "v"))
        used, e = (e, low, least), stored(small.filter("u <> v").distinct())
        drop(*used)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
        state = now


def apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs whose nodes aren't in one component yet."""
    of = lambda k: parts.select(F.col("node").alias(k), F.col("label").alias(f"l{k}"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").filter("la is null or lb is null or la <> lb").select("a", "b")


def settled(large: DataFrame, nodes: DataFrame, texts: DataFrame, parts: DataFrame) -> DataFrame:
    """Links (a, b) that connect all that is similar in the buckets of large (bucket, node), beyond the components of parts.

    Buckets in one component are settled. The nodes of the others are dealt into blocks by hash, of BLOCK nodes and
    BLOCK_GRAMS five-grams on average; pairs of blocks compare sizes and signatures of all their pairs, then the
    five-grams of what is left."""
    own = nodes.select("node", "n").join(parts, "node", "left").select("node", "n", F.coalesce("label", "node").alias("label"))
    met = stored(large.distinct().join(own, "node"))
    sizes = met.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n").alias("grams"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    dealt = stored(sizes.select("bucket", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int").alias("blocks")))
    placed = stored(met.select("bucket", "node", "label").distinct().join(dealt, "bucket").select("bucket", "node", "label", F.pmod(F.xxhash64("node", "bucket"), "blocks").cast("int").alias("block")))
    whole = nodes.join(placed, "node").filter(F.array_contains("bands", F.col("bucket")))
    blocks = stored(whole.groupBy("bucket", "block").agg(F.collect_list(F.struct("node", "n", "label", "bands", "sketch")).alias("members")))
    side = lambda k, m: blocks.select("bucket", F.col("block").alias(k), F.col("members").alias(m))
    two = dealt.select("bucket", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i")).select("bucket", "i", F.explode(F.sequence(F.col("i"), F.col("blocks") - 1)).alias("j"))
    two = two.join(side("i", "x"), ["bucket", "i"]).join(side("j", "y"), ["bucket", "j"]).select("bucket", "i", "j", "x", "y")

    def columns(members):
        get = lambda c: members.field(c).to_numpy(zero_copy_only=False)
        bands = members.field("bands").flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
        return get("node"), get("n"), get("label"), bands, np.frombuffer(b"".join(members.field("sketch").to_pylist()), "<u2").reshape(-1, SIZE)

    def meet(batches):
        for batch in batches:
            out: dict = {k: [] for k in ("bucket", "i", "j", "a", "b", "la", "lb")}
            for r in range(batch.num_rows):
                bucket, i, j = (batch.column(c)[r].as_py() for c in range(3))
                (ids, n, label, bands, sketch), (ids2, n2, label2, bands2, sketch2) = (columns(batch.column(c)[r].values) for c in (3, 4))
                found = []
                for k in range(len(ids)):
                    near = (label2 != label[k]) & (5 * np.minimum(n2, n[k]) >= 4 * np.maximum(n2, n[k]))
                    if i == j:
                        near[:k] = False
                    q = np.flatnonzero(near)
                    same = bands2[q] == bands[k]
                    first = same.argmax(1) if len(q) else q
                    q = q[same[np.arange(len(q)), first] & (bands[k][first] == bucket)]
                    q = q[(sketch2[q] == sketch[k]).mean(1) >= ESTIMATE] if len(q) else q
                    found += [(k, x) for x in q]
                if found:
                    p, q = np.array(found).T
                    for name, value in zip(out, (bucket, i, j, ids[p], ids2[q], label[p], label2[q])):
                        out[name].append(value)
            kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

    def link(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, sets = [], []
        for node, text in zip(right.column("node").to_pylist(), right.column("text").to_pylist()):
            g = np.unique(grams(word_codes(text)))
            if len(g):
                ids.append(node), sets.append(g)
        label, root, wanted, out = {}, {}, {}, []
        for row in left.to_pylist():
            for a, b, la, lb in zip(row["a"], row["b"], row["la"], row["lb"]):
                label[a], label[b] = la, lb
                wanted.setdefault(a, set()).add(b)

        def top(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        ids, size = np.array(ids, np.int64), np.array([len(g) for g in sets], np.int64)
        starts = np.cumsum(size) - size
        vocabulary, at = np.unique(np.concatenate(sets), return_inverse=True)
        for k, a in enumerate(ids.tolist()):
            if a not in wanted:
                continue
            mark = np.zeros(len(vocabulary), np.int64)
            mark[at[starts[k] : starts[k] + size[k]]] = 1
            both = np.add.reduceat(mark[at], starts)
            for b in ids[5 * both >= 4 * (size + size[k] - both)].tolist():
                if b in wanted[a] and (x := top(label[a])) != (y := top(label[b])):
                    root[max(x, y)] = min(x, y)
                    out.append((a, b))
        return pa.table({c: pa.array([o[k] for o in out], pa.int64()) for k, c in enumerate("ab")})

    at = ["bucket", "i", "j"]
    hits = stored(two.mapInArrow(meet, "bucket long, i int, j int, a array<long>, b array<long>, la array<long>, lb array<long>"))
    # a stored table's size is known, so that texts move only if many are wanted
    wanted = stored(hits.select(*at, F.explode(F.array_distinct(F.concat("a", "b"))).alias("node")))
    read = wanted.join(texts, "node").select(*at, "node", "text").toDF("at", "at_i", "at_j", "node", "text")
    links = stored(hits.groupBy(*at).cogroup(read.groupBy("at", "at_i", "at_j")).applyInArrow(link, "a long, b long"))
    drop(met, dealt, placed, blocks, hits, wanted)
    return links


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id of each document of docs (doc_id, text)."""
    ship(docs.sparkSession)
    sigs = stored(signatures(docs))
    # the smallest id stands for its words; stored, so that a join can split what a hot key brings
    owner = stored(sigs.groupBy("key").agg(F.min("doc_id").alias("node")))
    owned = stored(sigs.join(owner, "key"))
    drop(sigs, owner)
    nodes = owned.filter("doc_id = node and n > 0").select("node", "n", "bands", "sketch")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").filter("node is not null and text is not null")

    star, small, large = compared(nodes.select("node", F.explode("bands").alias("bucket")).select("bucket", "node"))
    first = stored(verified(plausible(star, nodes), texts))
    parts = stored(components(first))
    second = verified(plausible(apart(small, parts), nodes), texts)
    third = settled(large, nodes, texts, parts)

    several = owned.groupBy("doc_id").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x <> y").select("doc_id")
    same = owned.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    labels = components(first.unionAll(second).unionAll(third).unionAll(same))
    own = owned.select("doc_id", "node").join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("class_id")).distinct()
    none = docs.filter("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"))
    return own.unionAll(none)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir).select("doc_id", "text"))
