"""Token ids in shards of canonical, length-limited Huffman code.

The ids' counts over the corpus (one count for each id of the vocabulary) give code
lengths of MAX_BITS at most by package-merge (more only where more ids than 2**MAX_BITS occur); canonical codes follow from the lengths.
A shard holds documents in ascending id order, as blocks of about BLOCK ids. Texts are encoded once; their ids
wait in a table for the counts. Every block decodes on its own: it has the code lengths, its documents' lengths,
its bits, and a checkpoint of the bit offset for every STRIDE ids. Decoding looks as many bits as the longest code has up in a
table that gives id and length, and goes on at all checkpoints of a block at once.

write_files() has each task write the blocks of its shards as Parquet files (one row per block with its image) into a folder, by
Spark's committer; read_files() needs nothing but the folder's path.

Shards are ranges of (id, place in the input), so the rows of an id that repeats, or of no id, spread over shards;
there are as many as shuffle partitions, and more where the input has more than RANGE_BYTES for each.

Format of a block, little-endian: magic `HUF2`, u32 ids in the vocabulary, u32 bytes of the compressed code lengths, u32 documents, u64 ids,
u64 bits, u32 stride; the code lengths, a byte for each id, compressed by zlib; for each document i64 id, u8 whether the id is null, u64 ids; for each checkpoint
u64 bit offset; the bits, most significant first, and 8 zero bytes.

Defined results: null text counts as empty, such a document is the end id alone; rows
are in the order of id (null first), then of their place in the input; rows that repeat get a row each; an
empty table gives no rows; other columns are ignored; a text of any length is whole, a long one may fill a block of
its own.
"""

from __future__ import annotations

import heapq
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop, shared_dir, ship, stored, until_exit
from .units import byte_bpe, encoder, same_ids

END = 2
MAX_BITS = 16
STRIDE = 256
BLOCK = 1 << 20
RANGE_BYTES = 64 << 20
MAGIC = b"HUF2"
HEAD = "<4sIIIQQI"


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most limit bits (package-merge), or of as many as so many ids need; 0 for ids that don't occur."""
    ids = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    limit = max(limit, (len(ids) - 1).bit_length())
    if len(ids) == 1:
        lengths[ids] = 1
    if len(ids) < 2:
        return lengths
    order = ids[np.argsort(counts[ids], kind="stable")]
    weights = counts[order].astype(object)
    n = len(order)
    coins = [(int(w), i) for i, w in enumerate(weights)]
    levels, row = [], coins
    for _ in range(limit - 1):
        levels.append(row)
        packages = [(row[i][0] + row[i + 1][0], -1) for i in range(0, len(row) - 1, 2)]
        row = list(heapq.merge(coins, packages, key=lambda x: x[0]))
    levels.append(row)
    take = 2 * n - 2
    for row in reversed(levels):
        picked = row[:take]
        singles = [i for _, i in picked if i >= 0]
        lengths[order[singles]] += 1
        take = 2 * (len(picked) - len(singles))
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    code, last = 0, 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)).tolist():
        n = int(lengths[i])
        if n:
            code <<= n - last
            codes[i], last = code, n
            code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """The longest code's bits; id and length for each value of so many bits."""
    most = int(lengths.max(initial=1))
    codes, width = canonical(lengths), 1 << most
    symbol, size = np.zeros(width, np.uint32), np.zeros(width, np.uint8)
    for i in np.flatnonzero(lengths).tolist():
        n = most - int(lengths[i])
        a = int(codes[i]) << n
        symbol[a : a + (1 << n)], size[a : a + (1 << n)] = i, lengths[i]
    return most, symbol, size


def encode_block(docs: list[tuple[int | None, np.ndarray]], lengths: np.ndarray, codes: np.ndarray, packed: bytes | None = None) -> bytes:
    """packed: the lengths compressed, where that is done for many blocks."""
    packed = zlib.compress(lengths.tobytes()) if packed is None else packed
    ids = np.concatenate([d for _, d in docs])
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts, bits = ends - n, int(ends[-1])
    word, shift = starts >> 5, (64 - (starts & 31) - n).astype(np.uint64)
    value = codes[ids] << shift
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words = np.zeros((bits >> 5) + 3, np.uint64)
    words[word[first]] = np.add.reduceat(value >> np.uint64(32), first)
    words[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    head = struct.pack(HEAD, MAGIC, len(lengths), len(packed), len(docs), len(ids), bits, STRIDE) + packed
    table = np.zeros(len(docs), [("id", "<i8"), ("null", "u1"), ("n", "<u8")])
    table["id"], table["null"], table["n"] = [d or 0 for d, _ in docs], [d is None for d, _ in docs], [len(x) for _, x in docs]
    return head + table.tobytes() + starts[::STRIDE].astype("<u8").tobytes() + words.astype(">u4").tobytes()


def decode_block(data: bytes, tables: dict | None = None) -> list[tuple[int | None, np.ndarray]]:
    """The documents of a block; tables keeps the decoding table of the blocks before."""
    at = struct.calcsize(HEAD)
    if len(data) < at or data[:4] != MAGIC:
        raise ValueError("not a block")
    _, vocabulary, size_packed, n_docs, n, bits, stride = struct.unpack_from(HEAD, data)
    packed, tables = data[at : at + size_packed], {} if tables is None else tables
    if packed not in tables:
        lengths = np.frombuffer(zlib.decompress(packed), np.uint8)
        if len(lengths) != vocabulary:
            raise ValueError("not the code lengths of the vocabulary")
        tables.clear()
        tables[packed] = decode_table(lengths)
    most, symbol, size = tables[packed]
    at += size_packed
    docs = np.frombuffer(data, [("id", "<i8"), ("null", "u1"), ("n", "<u8")], n_docs, at)
    at += docs.nbytes
    lanes = -(-n // stride)
    cursor = np.frombuffer(data, "<u8", lanes, at).astype(np.int64)
    at += 8 * lanes
    words = np.frombuffer(data, ">u4", (len(data) - at) // 4, at).astype(np.uint64)
    out = np.zeros((stride, lanes), np.uint32)
    for step in range(stride):
        live = lanes if step < n - (lanes - 1) * stride else lanes - 1  # the last may be shorter
        c = cursor[:live]
        w = c >> 5
        both = (words[w] << np.uint64(32)) | words[w + 1]
        peek = ((both >> (64 - most - (c & 31)).astype(np.uint64)) & np.uint64((1 << most) - 1)).astype(np.int64)
        out[step, :live] = symbol[peek]
        cursor[:live] += size[peek]
    ids = out.T.ravel()[:n]
    ends = np.cumsum(docs["n"]).astype(np.int64)
    return [(None if d["null"] else int(d["id"]), ids[e - int(d["n"]) : e]) for d, e in zip(docs, ends.tolist())]


def range_count(df: DataFrame) -> int:
    """Shuffle partitions, or as many as the planner's estimate of the input's bytes needs."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    # an estimate of many products is no size; a table's is that of its files
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // RANGE_BYTES), 10_000_000), 1)


def token_table(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """shard, row, first, doc_id, ids: each document's ids with the end id, in ascending order of id by
    shard and row; first counts the ids before it in its shard."""
    spark = ship(docs.sparkSession)
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n, fast = ranges or range_count(d), same_ids(tokenizer)
    kind = id_type(tokenizer)
    width = np.dtype(kind).itemsize

    def encode(batches):
        from pyspark import TaskContext

        shard, tokens, row, first = TaskContext.get().partitionId(), encoder(tokenizer, fast), 0, 0
        end = np.array([END], kind).tobytes()
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            for i in range(0, len(texts), 1000):
                data = [np.frombuffer(x, "<u4").astype(kind).tobytes() + end for x in tokens.encode([t or "" for t in texts[i : i + 1000]])]
                before = np.cumsum([first, *(len(x) // width for x in data)])
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard] * len(data), pa.int32()), "row": pa.array(range(row, row + len(data)), pa.int64()), "first": pa.array(before[:-1], pa.int64()), "doc_id": keys.slice(i, 1000), "ids": pa.array(data, pa.binary())})
                row, first = row + len(data), int(before[-1])

    order = [F.col("doc_id").asc_nulls_first(), "place"]
    ordered = d.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order).drop("place")
    return stored(ordered.mapInArrow(encode, "shard int, row long, first long, doc_id long, ids binary"), "zstd")


def id_type(tokenizer: str) -> str:
    return "<u2" if byte_bpe(tokenizer).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def id_counts(table: DataFrame, tokenizer: str) -> np.ndarray:
    """How often each id stands in the corpus; a vector per partition, summed in a tree."""
    size, kind = byte_bpe(tokenizer).get_vocab_size(with_added_tokens=True), id_type(tokenizer)

    def count(batches):
        counts = np.zeros(size, np.int64)
        for b in batches:
            counts += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), kind), minlength=size)
        yield pa.RecordBatch.from_pydict({"counts": pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())})

    def add(batches):
        counts = np.zeros(size, np.int64)
        for b in batches:
            for c in b.column(0).to_pylist():
                counts += np.frombuffer(zlib.decompress(c), np.int64)
        yield pa.RecordBatch.from_pydict({"counts": pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())})

    found, n = table.select("ids").mapInArrow(count, "counts binary"), table.rdd.getNumPartitions()
    while n > 64:
        n = -(-n // 64)
        found = found.repartition(n).mapInArrow(add, "counts binary")
    return sum((np.frombuffer(zlib.decompress(r.counts), np.int64) for r in found.collect()), np.zeros(size, np.int64))


def write_files(table: DataFrame, tokenizer: str, lengths: np.ndarray, path: str) -> None:
    """Write the blocks of token_table() to a folder: shard, block (the shard's row at which it begins),
    first (the shard's ids before it), ids and data, the block's image."""
    held, kind = table.sparkSession.sparkContext.broadcast(lengths), id_type(tokenizer)

    def encode(batches):
        lengths = held.value
        codes, packed, waiting, size, at, begin = canonical(lengths), zlib.compress(lengths.tobytes()), [], 0, (-1, -1), 0

        def made():
            return pa.RecordBatch.from_pydict({"shard": pa.array([at[0]], pa.int32()), "block": pa.array([at[1] - len(waiting)], pa.int64()), "first": pa.array([begin], pa.int64()), "ids": pa.array([size], pa.int64()), "data": pa.array([encode_block(waiting, lengths, codes, packed)], pa.binary())})

        for b in batches:
            for shard, row, first, key, data in zip(*(b.column(c).to_pylist() for c in ("shard", "row", "first", "doc_id", "ids"))):
                if waiting and (size >= BLOCK or at != (shard, row)):
                    yield made()
                    waiting, size = [], 0
                ids = np.frombuffer(data, kind)
                begin = begin if waiting else first
                waiting.append((key, ids))
                size, at = size + len(ids), (shard, row + 1)
        if waiting:
            yield made()

    table.mapInArrow(encode, FILE).write.parquet(path)


#: What is read, and what a file has for each block.
NAMES = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
FILE = "shard int, block long, first long, ids long, data binary"


def read_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document from the files of a folder; with_ids also ids, as bytes of little-endian unsigned 32-bit integers."""
    ship(spark)
    shards = spark.read.schema(FILE).parquet(path)
    starts, at = {}, 0
    for r in shards.groupBy("shard").agg(F.sum("ids").alias("ids")).orderBy("shard").collect():  # a row per range
        starts[r.shard] = at
        at += r.ids
    held = spark.sparkContext.broadcast(starts)

    def decode(batches):
        starts, tables = held.value, {}
        for b in batches:
            for shard, first, data in zip(*(b.column(c).to_pylist() for c in ("shard", "first", "data"))):
                start, rows = starts[shard] + first, []
                for key, ids in decode_block(data, tables):
                    raw = ids.astype("<u4").tobytes()
                    rows.append((key, start, len(ids), zlib.crc32(raw), *([raw] if with_ids else ())))
                    start += len(ids)
                kinds = [pa.int64()] * 4 + [pa.binary()] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], NAMES[: len(kinds)])

    return shards.select("shard", "first", "data").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    table = token_table(documents(spark, sf_dir), path)
    lengths = code_lengths(id_counts(table, path))
    out = f"{shared_dir(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    write_files(table, path, lengths, out)
    until_exit(spark, out)
    drop(table)
    return read_files(spark, out)
