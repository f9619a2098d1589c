"""Toxicity by a convolutional text classifier, trained in numpy.

A word (a run of letters, lower case) is the sum of hashed embeddings: of itself and of its beginnings of
HEADS letters, each in one of SLOTS slots, which all have an embedding. Filters of several
widths slide over the words, their largest response in the text (max pooling,
ReLU) feeds a logistic output. As a filter is linear, its response is a sum of one
vector per word and place; scoring keeps these vectors per worker for the words that it meets, takes whole texts in
slices, and needs no more memory for a long one.

Training takes at most TRAIN_TOXIC and TRAIN_CLEAN labelled documents of at most
TRAIN_CHARS characters, chosen by a hash of the id among those that are not held out.
A fifth of them is kept for calibration. Languages are told apart by function words, without labels: texts are grouped by
the shares of their MARKS most common words (k-means on the sphere, LANGUAGES groups). For each group
the raw threshold with the largest surplus of right over wrong alarms is
found, and scores are rescaled so that it lies at 0.3. Groups with few detections
use the threshold found over all. Labels, lang, source and doc_id are not inputs.

Defined results: null and empty texts score as texts without words; a label that
repeats counts once, 1 before 0; of an id's texts the first in order is learnt; ties of the training order are broken by id; without labels of both kinds every score is 0; rows
that repeat get a row each; a null id is not held out; texts of any length are scored whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold, ship, worker_state

SLOTS = 1 << 17
HEADS = (4, 5, 6)
DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS = 2_500, 3_500, 40_000
MARKS, LANGUAGES = 256, 8
SLICE = 100_000
DECAY = 0.01
#: Epochs without a smaller loss after which training ends.
PATIENCE = 2
INIT = 0.05
#: Words that a worker remembers; beyond that it starts anew.
HELD = 300_000
WORD = re.compile(r"[^\W\d_]+")
PLACES = sum(WIDTHS) * FILTERS


class Words:
    """Numbers of the words of a text, 1 and up; between spaces by a cache. 0 stands for no word.
    slots: by number, those of the word and its beginnings; SLOTS, which stays zero, for beginnings that it hasn't."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.units: dict[str, bytes] = {}
        self.heads: dict[str, int] = {}
        self.slots = [(SLOTS,) * (1 + len(HEADS))]

    def head(self, start: str) -> int:
        if start not in self.heads:
            self.heads[start] = zlib.crc32(start.encode()) % SLOTS
        return self.heads[start]

    def numbers(self, text: str) -> np.ndarray:
        units = text.split(" ")
        number, slots, head = self.number, self.slots, self.head
        for u in set(units).difference(self.units):
            own = []
            for w in WORD.findall(u.lower()):
                n = number.get(w)
                if n is None:
                    n = number[w] = len(slots)
                    slots.append((zlib.crc32(f"{w}$".encode()) % SLOTS, *[head(w[:k]) if len(w) >= k else SLOTS for k in HEADS]))
                own.append(n.to_bytes(4, "little"))
            self.units[u] = b"".join(own)
        return np.frombuffer(b"".join(map(self.units.__getitem__, units)), "<i4")


def _segments(many: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers with a gap of zeros behind each text (and a zero for an empty one), and where texts begin."""
    gap = np.zeros(max(WIDTHS) - 1, np.int64)
    parts = [np.concatenate([x if len(x) else [0], gap]).astype(np.int64) for x in many]
    ends = np.cumsum([len(p) for p in parts])
    return np.concatenate([*parts, gap]), ends - [len(p) for p in parts]


class Model:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, INIT, (SLOTS + 1, DIM)).astype(np.float32)
        self.e[-1] = 0
        self.w = [rng.normal(0, 0.4, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.b = [np.full(FILTERS, -0.1, np.float32) for _ in WIDTHS]
        self.v = rng.normal(0, 0.4, len(WIDTHS) * FILTERS).astype(np.float32)
        self.c = np.float32(-2)
        self.marks = np.zeros(0, np.int64)
        self.groups = np.zeros((1, 0), np.float32)
        self.thresholds = np.full(1, 0.5)

    def vectors(self, slots: np.ndarray) -> np.ndarray:
        """A row for each word: what it adds to each place of each filter."""
        return self.e[slots].sum(1) @ np.concatenate([w[k] for w in self.w for k in range(len(w))], 1)

    def responses(self, g: np.ndarray) -> np.ndarray:
        """Of each filter at each place, from the words' vectors; the last places of the widest lack."""
        n, at, out = len(g) - max(WIDTHS) + 1, 0, []
        for width, b in zip(WIDTHS, self.b):
            r = g[:n, at : at + FILTERS] + b
            for k in range(1, width):
                r += g[k : n + k, at + k * FILTERS : at + (k + 1) * FILTERS]
            out.append(r)
            at += width * FILTERS
        return np.concatenate(out, 1)

    def pooled(self, many: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
        """The largest responses in each text, from its words' rows of vectors; some texts at once, a long one in slices."""
        out = np.zeros((len(many), len(WIDTHS) * FILTERS), np.float32)
        i = 0
        while i < len(many):
            n, k = len(many[i]), i + 1
            while k < len(many) and n + len(many[k]) <= SLICE:
                n, k = n + len(many[k]), k + 1
            ids, starts = _segments(many[i:k])
            if len(ids) > 2 * SLICE:
                for a in range(0, len(ids) - max(WIDTHS) + 1, SLICE):
                    out[i] = np.maximum(out[i], self.responses(vectors[ids[a : a + SLICE + max(WIDTHS) - 1]]).max(0))
            else:
                out[i:k] = np.maximum(np.maximum.reduceat(self.responses(vectors[ids]), starts, 0), 0)
            i = k
        return out

    def raw(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(pooled @ self.v + self.c, -30, 30)))

    def shares(self, many: list[np.ndarray], first: np.ndarray) -> np.ndarray:
        """The marks' shares of each text, on the sphere; first: the mark (its place) that a word's own slot is, or -1."""
        out = np.zeros((len(many), len(self.marks)), np.float32)
        for i, x in enumerate(many):
            m = first[x]
            out[i] = np.sqrt(np.bincount(m[m >= 0], minlength=len(self.marks)))
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def group(self, shares: np.ndarray) -> np.ndarray:
        return (shares @ self.groups.T).argmax(1)

    def mark_of(self, slots: np.ndarray) -> np.ndarray:
        """By word: the place of its own slot among the marks, or -1."""
        at = np.searchsorted(self.marks, slots[:, 0])
        at[at == len(self.marks)] = 0
        return np.where(self.marks[at] == slots[:, 0], at, -1) if len(self.marks) else np.full(len(slots), -1)

    def learn_groups(self, many: list[np.ndarray], slots: np.ndarray, rounds: int = 12) -> None:
        """Marks are the words that stand in most texts."""
        seen = np.bincount(np.concatenate([np.unique(slots[x, 0]) for x in many if len(x)] or [np.zeros(0, np.int64)]), minlength=SLOTS)
        most = np.argsort(-seen, kind="stable")[:MARKS]
        self.marks = np.sort(most[seen[most] > 0])
        x = self.shares(many, self.mark_of(slots))
        x = x[x.any(1)] if x.any() else np.zeros((1, len(self.marks)), np.float32)
        rng, centers = np.random.default_rng(5), [x[0]]
        while len(centers) < LANGUAGES:  # texts that are little like the groups so far are likelier
            far = np.square(1 - (x @ np.array(centers).T).max(1).clip(0, 1)).astype(float) + 1e-12
            centers.append(x[rng.choice(len(x), p=far / far.sum())])
        self.groups = np.array(centers, np.float32)
        for _ in range(rounds):
            own = self.group(x)
            for k in range(len(self.groups)):
                if (own == k).any():
                    self.groups[k] = x[own == k].mean(0) / max(float(np.linalg.norm(x[own == k].mean(0))), 1e-9)

    def score(self, raw: np.ndarray, groups: np.ndarray) -> np.ndarray:
        t = self.thresholds[groups]
        return np.where(raw < t, 0.3 * raw / t, 0.3 + 0.7 * (raw - t) / (1 - t))

    def step(self, many: list[np.ndarray], y: np.ndarray, slots: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, float]:
        """Gradients of the dense parameters, touched slots with theirs, and that of the constant."""
        ids, starts = _segments(many)
        words, ids = np.unique(ids, return_inverse=True)
        own = self.e[slots[words]].sum(1)
        r = self.responses((own @ np.concatenate([w[k] for w in self.w for k in range(len(w))], 1))[ids])
        top = np.maximum.reduceat(r, starts, 0)
        col, row = np.nonzero((r == np.repeat(top, np.diff(np.append(starts, len(r))), 0)).T)
        doc = np.searchsorted(starts, row, "right") - 1
        _, first = np.unique(col * len(many) + doc, return_index=True)
        at = row[first].reshape(r.shape[1], len(many)).T  # the first place of the largest response
        on = top > 0
        pooled = top * on
        g = ((self.raw(pooled) - y) / len(many)).astype(np.float32)
        back = g[:, None] * self.v * on
        dense: list[np.ndarray] = []
        touched, grads = [], []
        for k, (width, w) in enumerate(zip(WIDTHS, self.w)):
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            dw = np.zeros_like(w)
            for j in range(width):
                word = ids[at[:, cols] + j]
                dw[j] = np.einsum("dfe,df->ef", own[word], back[:, cols])
                touched.append(slots[words[word]].reshape(-1, slots.shape[1]))
                grads.append((w[j].T[None] * back[:, cols, None]).reshape(-1, DIM))
            dense.append(dw)
        dense += [back[:, k * FILTERS : (k + 1) * FILTERS].sum(0) for k in range(len(WIDTHS))]
        dense.append(g @ pooled)
        touched, grads = np.concatenate(touched), np.concatenate(grads)
        used = np.flatnonzero(np.abs(grads).sum(1))
        flat = touched[used].ravel()
        sure, place = np.unique(flat, return_inverse=True)
        total = np.zeros((len(sure), DIM), np.float32)
        np.add.at(total, place, np.repeat(grads[used], slots.shape[1], 0))
        return dense, sure, total, float(g.sum())

    def train(self, many: list[np.ndarray], y: np.ndarray, slots: np.ndarray, check: tuple[list[np.ndarray], np.ndarray], epochs: int = 12, batch: int = 32, rate: float = 0.02, decay: float = DECAY, seed: int = 11) -> None:
        """Adam; of the embeddings only the touched rows take a step, all shrink by decay."""
        rng, params = np.random.default_rng(seed), [*self.w, *self.b, self.v]
        m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        me, se = np.zeros_like(self.e), np.zeros_like(self.e)
        mc = sc = 0.0
        best, kept, step, worse = np.inf, None, 0, 0
        for _ in range(epochs):
            order = rng.permutation(len(many))
            for i in range(0, len(order), batch):
                take = order[i : i + batch]
                grads, at, total, gc = self.step([many[d] for d in take], y[take], slots)
                step += 1
                ca, cb = 1 - 0.9**step, 1 - 0.999**step
                for p, g, a, b in zip(params, grads, m, s):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= rate * (a / ca) / (np.sqrt(b / cb) + 1e-8)
                me[at] = 0.9 * me[at] + 0.1 * total
                se[at] = 0.999 * se[at] + 0.001 * total * total
                self.e[at] -= rate * (me[at] / ca) / (np.sqrt(se[at] / cb) + 1e-8)
                self.e *= 1 - decay
                self.e[-1] = 0
                mc, sc = 0.9 * mc + 0.1 * gc, 0.999 * sc + 0.001 * gc * gc
                self.c -= np.float32(rate * (mc / ca) / (np.sqrt(sc / cb) + 1e-8))
            p = self.raw(self.pooled(check[0], self.vectors(slots))) if len(check[0]) else np.zeros(0)
            loss = -np.mean(np.log(np.clip(np.where(check[1] == 1, p, 1 - p), 1e-6, 1))) if len(p) else 0
            worse = 0 if loss < best else worse + 1
            if loss < best:
                best, kept = loss, ([x.copy() for x in (self.e, *params)], self.c)
            if worse == PATIENCE:
                break
        for p, k in zip((self.e, *params), kept[0]):
            p[...] = k
        self.c = kept[1]

    def calibrate(self, raw: np.ndarray, y: np.ndarray, groups: np.ndarray, least: int = 12) -> None:
        def best(r: np.ndarray, t: np.ndarray) -> tuple[float, int]:
            order = np.argsort(-r, kind="stable")
            gain = np.cumsum(np.where(t[order] == 1, 1, -1))
            k = int(gain.argmax()) if len(gain) else 0
            if not len(gain) or gain[k] <= 0:
                return 0.5, 0
            low = r[order[k + 1]] if k + 1 < len(r) else 0.0
            return float((r[order[k]] + low) / 2), int(gain[k])

        overall, _ = best(raw, y)
        own = [best(raw[groups == i], y[groups == i]) for i in range(len(self.groups))]
        self.thresholds = np.clip([t if gain >= least else overall for t, gain in own], 0.02, 0.98)


def fit(texts: list[str], toxic: list[int]) -> Model | None:
    """A model of labelled texts, in any order that is always the same; None without both labels."""
    y = np.array(toxic)
    if len(set(toxic)) < 2:
        return None
    model, words = Model(), Words()
    many = [words.numbers(t) for t in texts]
    slots = np.array(words.slots, np.int64)
    check = np.arange(len(texts)) % 5 == 0
    if len(set(y[check].tolist())) < 2 or len(set(y[~check].tolist())) < 2:
        check[:] = False
    rest = np.flatnonzero(~check)
    held = np.flatnonzero(check) if check.any() else rest
    of = lambda k: [many[i] for i in k]
    model.learn_groups(of(rest), slots)
    model.train(of(rest), y[rest], slots, (of(held), y[held]))
    model.calibrate(model.raw(model.pooled(of(held), model.vectors(slots))), y[held], model.group(model.shares(of(held), model.mark_of(slots))))
    return model


class Scorer:
    """A model with the vectors of the words met so far."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.words, self.done = Words(), 0
        self.vectors, self.first = np.zeros((1024, PLACES), np.float32), np.full(1024, -1)

    def scores(self, texts: list[str]) -> np.ndarray:
        if len(self.words.slots) > HELD:
            self.clear()
        many = [self.words.numbers(t) for t in texts]
        n = len(self.words.slots)
        while len(self.vectors) < n:
            self.vectors, self.first = np.concatenate([self.vectors, np.zeros_like(self.vectors)]), np.concatenate([self.first, np.full_like(self.first, -1)])
        new = np.array(self.words.slots[self.done :], np.int64).reshape(-1, 1 + len(HEADS))
        self.vectors[self.done : n], self.first[self.done : n] = self.model.vectors(new), self.model.mark_of(new)
        self.done = n
        return self.model.score(self.model.raw(self.model.pooled(many, self.vectors)), self.model.group(self.model.shares(many, self.first)))


def training_rows(docs: DataFrame, labels: DataFrame) -> list:
    """(doc_id, text, toxic) of the bounded training sample."""
    l = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id"), 4) != 2)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    short = docs.filter(F.length("text") <= TRAIN_CHARS).select("doc_id", "text")
    take = lambda v, n: l.filter(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ids = take(1, TRAIN_TOXIC).unionAll(take(0, TRAIN_CLEAN))
    # of an id that repeats one text, so that no more rows come than ids
    rows = short.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    return sorted(rows, key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.text))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs (doc_id, text)."""
    spark = ship(docs.sparkSession)
    rows = training_rows(docs, labels)
    model = fit([r.text for r in rows], [int(r.toxic == 1) for r in rows])
    held = spark.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    def score(batches):
        scorer = worker_state(key, lambda: held.value and Scorer(held.value))
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            out = [scorer.scores(texts[i : i + 64]) for i in range(0, len(texts), 64)] if scorer else []
            s = np.concatenate(out) if out else np.zeros(len(texts))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "held_out": b.column(1), "score": pa.array(s.astype(float), pa.float64()), "predicted": pa.array((s >= 0.3).astype(np.int32), pa.int32())})

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "text")
    return d.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
