"""The training-data operators on small fixtures: nulls, empty and long texts, ties, repeats,
empty tables, clashing columns; against brute force where SQL can't express them."""

import collections
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidewater.llm import (
    op1_token_counts,
    op2_chat_format,
    op3_toxicity,
    op4_ogg_media,
    op5_decontamination,
    op6_pii_surrogates,
    op7_packing,
    op8_huffman_output,
    op9_language_id,
    op10_near_dedup,
    pipeline,
    registry,
    units,
)

DATA = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, score string, key string"
ODD = [None, "", " ", "  two  spaces ", "line\nbreak\n", "x" * 30_000, "word " * 20_000, "日本語 текст ▁ <|endoftext|> <s>", "tie", "tie", "a\x00b\x1cc\x85d", "it's  fine\t\n ok"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, ids that repeat and are null, extra columns with names that operators also use."""
    rows = [(i if i != 3 else None, t, "en", "s", "k") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[-1]], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def texts(df):
    return collections.Counter((r.doc_id, r.text or "") for r in df.collect())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.sql(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{t}')")
    df = registry.QUERIES[name](spark, DATA)
    cols = ", ".join(df.columns)
    assert sorted(map(tuple, df.collect())) == sorted(c.sql(f"select {cols} from ({registry.ORACLES[name]})").fetchall())


def test_registered():
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert len(registry.QUERIES) == 11


def test_token_counts(spark, odd, empty, docs):
    sp = op1_token_counts.units.pieces(PIECES)
    for df in (odd, docs):
        want = collections.Counter((d, len(t.encode()), len(sp.encode(t))) for (d, t), n in texts(df).items() for _ in range(n))
        assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in op1_token_counts.token_counts(df, PIECES).collect()) == want
    assert op1_token_counts.token_counts(empty, PIECES).count() == 0


EVENTS = "conv_id string, seq long, message long, turn long, op string, role string, text string"


def folded(spark, events):
    e = spark.createDataFrame(events, EVENTS)
    out = op2_chat_format.read_back(op2_chat_format.render(op2_chat_format.fold_events(e))).collect()
    return sorted(((r.conv_id, [tuple(m) for m in r.messages], r.loss) for r in out), key=str)


def test_chat_events(spark):
    e = [("c", 1, 1, 0, "message", "user", "hi"), ("c", 2, 2, 1, "message", "assistant", "a"), ("c", 3, 2, 1, "delta", None, "b"), ("c", 4, 3, 2, "message", "user", "gone"),
         ("c", 5, 2, 1, "regenerate", "assistant", "A"), ("c", 6, 2, 1, "delta", None, "#<\\l"), ("c", 7, 1, 0, "edit", "user", "hello"), (None, None, 9, None, "message", None, None), (None, None, 8, 3, "message", "assistant", "é:")]
    want = [("c", [("user", "hello"), ("assistant", "A#<\\l")], "A#<\\l"), (None, [("", "")], ""), (None, [("assistant", "é:")], "é:")]
    assert folded(spark, e) == folded(spark, e * 2) == sorted(want, key=str)
    assert folded(spark, []) == []
    # deliveries again, deltas without a number, ties
    e = [("c", 1, 1, 0, "message", "user", "hi"), ("c", 2, 1, 0, "delta", "user", "X"), ("c", 2, 1, 0, "delta", "user", "X"), ("c", None, 1, 0, "delta", "user", "!"), ("c", 5, 2, 1, "edit", "user", "E"), ("c", 5, 2, 1, "edit", "user", "E"), ("c", 5, 2, 1, "delta", "user", "b"), ("c", 5, 2, 1, "delta", "user", "a")]
    assert folded(spark, e) == [("c", [("user", "hiX!"), ("user", "Eab")], "")]


def plain_fold(events):
    """What the docstring says, a conversation at a time, event by event."""
    convs = collections.defaultdict(list)
    for e in dict.fromkeys(events):
        convs[e[0] if e[0] is not None else (None, e[2])].append(e)
    out = []
    for conv, own in convs.items():
        far = lambda e: (-(10**37) if e[4] == "message" else 10**37) if e[1] is None else e[1]
        turn = lambda e: -(1 << 62) if e[3] is None else e[3]
        cut = lambda t: max((far(e) for e in own if e[4] == "regenerate" and turn(e) < t), default=None) if not isinstance(conv, tuple) else None
        messages = {}
        for e in sorted(own, key=lambda e: (far(e), e[4] == "delta", e[6] or "", e[5] or "")):
            c = cut(turn(e))
            if c is None or far(e) > c:
                role, text = messages.get((turn(e), e[2]), (e[5] or "", ""))
                messages[(turn(e), e[2])] = (role, text + (e[6] or "") if e[4] == "delta" else e[6] or "")
        said = [messages[k] for k in sorted(messages)]
        if said:
            out.append((conv if not isinstance(conv, tuple) else None, said, "".join(t for r, t in said if r == "assistant")))
    return sorted(out, key=str)


def test_chat_events_at_random(spark):
    rng = random.Random(3)
    events = []
    for c in ("a", "b", "c", "d", None):
        for _ in range(400):
            m = rng.randrange(160)
            events.append((c, rng.choice([None, *range(300)]), m, m // 2 if m % 7 else None, rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate"] if m % 5 == 0 else ["message", "delta", "delta", "edit"]), ["user", "assistant", None][m % 3], rng.choice(["x", "", None, "<é#", "</turn>\n", ": \\b"])))
    events += events[::3]
    assert folded(spark, events) == plain_fold(events)


def test_toxicity(spark, docs, empty):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    out = op3_toxicity.toxicity(docs.union(docs.limit(1)), labels.union(labels)).collect()
    assert len(out) == 201 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert [r.score for r in op3_toxicity.toxicity(docs.limit(2), labels.limit(0)).collect()] == [0, 0]
    assert op3_toxicity.toxicity(empty, labels).count() == 0
    assert sorted(map(tuple, op3_toxicity.training_rows(docs.union(docs), labels))) == sorted(map(tuple, op3_toxicity.training_rows(docs, labels)))
    random.seed(1)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}".replace("w", "") for i in range(300)]
    make = lambda bad: " ".join([*random.choices(words, k=80), *(["zorgle"] * bad), *random.choices(words, k=20)])
    y = [i % 3 == 0 for i in range(400)]
    m = op3_toxicity.fit([make(b) for b in y], list(map(int, y)))
    texts = [make(i % 2) for i in range(200)] + ["", "a " * 250_000 + "zorgle"]
    s = op3_toxicity.Scorer(m).scores(texts)
    assert ((s[:200] >= 0.3) == (np.arange(200) % 2 == 1)).mean() > 0.97 and s[200] < 0.3 <= s[201]
    # against a plain forward pass, a word and a place at a time
    for t, got in zip(texts[:12] + ["", "one", "one two"], op3_toxicity.Scorer(m).scores(texts[:12] + ["", "one", "one two"])):
        vecs = []
        for w in re.findall(r"[^\W\d_]+", t.lower()) or [None]:
            own = [f"{w}$", *(w[:k] for k in op3_toxicity.HEADS if len(w) >= k)] if w else []
            vecs.append(sum((m.e[zlib.crc32(x.encode()) % op3_toxicity.SLOTS] for x in own), np.zeros(op3_toxicity.DIM)))
        most = []
        for width, w, b in zip(op3_toxicity.WIDTHS, m.w, m.b):
            for f in range(op3_toxicity.FILTERS):
                most.append(max(0, max(b[f] + sum(float(vecs[p + k] @ w[k][:, f]) for k in range(width) if p + k < len(vecs)) for p in range(len(vecs)))))
        raw = 1 / (1 + np.exp(-(np.dot(most, m.v) + m.c)))
        number = op3_toxicity.Words()
        group = m.group(m.shares([number.numbers(t)], m.mark_of(np.array(number.slots))))[0]
        t = m.thresholds[group]
        assert abs(got - (0.3 * raw / t if raw < t else 0.3 + 0.7 * (raw - t) / (1 - t))) < 1e-3


def test_toxicity_gradients():
    """Against differences of the loss."""
    rng = np.random.default_rng(1)
    m, words = op3_toxicity.Model(), op3_toxicity.Words()
    m.e, m.v, m.w, m.b = m.e.astype(float), m.v.astype(float), [w.astype(float) for w in m.w], [b.astype(float) for b in m.b]
    m.e[:-1] = rng.normal(0, 0.5, (op3_toxicity.SLOTS, op3_toxicity.DIM))
    many = [words.numbers(t) for t in ("alpha beta gamma delta", "beta beta epsilon", "zeta")]
    slots, y = np.array(words.slots), np.array([1, 0, 1])

    def loss():
        p = m.raw(m.pooled(many, m.vectors(slots)))
        return -np.mean(np.log(np.where(y == 1, p, 1 - p)))

    dense, at, total, c = m.step(many, y, slots)
    for p, g in [*zip([*m.w, *m.b, m.v], dense), (m.e, None)]:
        for _ in range(12):
            k = tuple(rng.integers(0, n) for n in p.shape) if g is not None else (int(rng.choice(at)), int(rng.integers(0, op3_toxicity.DIM)))
            own, old = g[k] if g is not None else total[np.searchsorted(at, k[0]), k[1]], p[k]
            p[k] = old + 1e-4
            up = loss()
            p[k] = old - 1e-4
            down = loss()
            p[k] = old
            assert abs((up - down) / 2e-4 - own) < 2e-3


def test_ogg(spark, odd, empty):
    rows = op4_ogg_media.media_features(op4_ogg_media.media_columns(odd)).collect()
    want = collections.Counter()
    for (d, t), n in texts(odd).items():
        p, size = op4_ogg_media.payload(t)
        want[(d, size, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))] += n
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    assert op4_ogg_media.media_features(op4_ogg_media.media_columns(empty)).count() == 0
    assert op4_ogg_media.checksum(b"") == 0 and op4_ogg_media.checksum(b"\x01") == 0x04C11DB7
    data = op4_ogg_media.write(b"abc" * 64_000)
    samples, info = op4_ogg_media.read(data)
    assert samples == b"abc" * 64_000 and info["streams"] == 2 and info["duration_us"] == 24_000_000
    for at in (30, 5_000, len(data) - 1):
        with pytest.raises(ValueError):
            op4_ogg_media.read(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    with pytest.raises(ValueError):
        op4_ogg_media.read(data[: len(data) // 2])


def test_ogg_level(spark, odd):
    """The mean of the whole payload, also of periodic ones."""
    d = spark.createDataFrame([(1, ("z" + "a" * 99) * 192), (2, "é" * 5_000)], "doc_id long, text string")
    for df in (d, odd):
        for r, (_, t) in zip(op4_ogg_media.media_features(op4_ogg_media.media_columns(df)).collect(), df.select("doc_id", "text").collect()):
            p = op4_ogg_media.payload(t)[0]
            assert f"level={sum(p) // len(p)};" in r.feature


def test_ogg_packet_across_pages():
    def page(serial, number, flags, lacing, body):
        return op4_ogg_media._page(serial, number, flags, 510, bytes(lacing), body)

    data = page(7, 0, 2, [3], b"abc") + page(7, 1, 0, [2, 255], b"de" + b"x" * 255) + page(8, 0, 6, [1], b"z") + page(7, 2, 5, [255, 0], b"y" * 255)
    streams, n = op4_ogg_media.demultiplex(data)
    with pytest.raises(ValueError):
        op4_ogg_media.demultiplex(data + page(8, 1, 4, [1], b"z"))  # after the stream's end
    with pytest.raises(ValueError):
        op4_ogg_media.demultiplex(data[: -len(page(7, 2, 5, [255, 0], b"y" * 255))])
    made = list(op4_ogg_media.pages(op4_ogg_media.write(b"abc" * 64_000)))
    assert any(flags & 1 for flags, *_ in made) and sum(bool(flags & 4) for flags, *_ in made) == 2
    assert n == 4 and [p for _, p in streams[7]] == [b"abc", b"de", b"x" * 255 + b"y" * 255] and [p for _, p in streams[8]] == [b"z"]


def contained_by_hand(docs, items):
    cut = lambda t: [w for w in re.split(r"[^\w]+|_", t.lower()) if w]
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    best = {}
    wanted = {(i, x): (min(5, len(w)), grams(w, min(5, len(w)))) for i, x in items if x is not None and (w := cut(x))}
    for d, t in docs:
        has = {n: grams(cut(t or ""), n) for n in range(1, 6)}
        for (i, x), (n, own) in wanted.items():
            if t is not None:
                both = len(own & has[n])
                if both / len(own) >= 0.8 - 1e-12:
                    best[d, i] = max(best.get((d, i), (0,)), (both / len(own), len(own), both))
    return sorted(((d, i, n, both, c) for (d, i), (c, n, both) in best.items()), key=str)


@pytest.mark.parametrize("broadcast", [op5_decontamination.BROADCAST, 3])
def test_contained(spark, empty, monkeypatch, broadcast):
    """Against brute force and the SQL, with sketches that are broadcast and that aren't: repeated and null ids, short items, ties."""
    monkeypatch.setattr(op5_decontamination, "BROADCAST", broadcast)
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcde", k=2))
    items = [(i % 40 if i % 11 else None, " ".join(word() for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 12, 40, 90])))) for i in range(60)] + [(77, None), (78, ""), (79, "?!"), (1, "Too Short"), (2, "too, short")]
    docs = [(i % 70 if i % 9 else None, None if i % 17 == 16 else " ".join([word() for _ in range(rng.randrange(60))] + (items[rng.randrange(len(items))][1] or "").upper().split() + ["too short;"] * (i % 5 == 0) + [word() for _ in range(rng.choice([0, 5, 500]))])) for i in range(90)]
    docs += docs[:3] + [(500, ""), (None, None)]
    d = spark.createDataFrame([(*r, "a", "b", "c") for r in docs], SCHEMA)
    b = spark.createDataFrame(items, "item_id long, text string")
    out = sorted((tuple(r) for r in op5_decontamination.contained_items(d, b).collect()), key=str)
    assert out == contained_by_hand(docs, items) and len(out) > 40
    c = duckdb.connect()
    c.register("documents", pa.table({"doc_id": pa.array([x for x, _ in docs], pa.int64()), "text": [t for _, t in docs]}))
    c.register("benchmark", pa.table({"item_id": pa.array([x for x, _ in items], pa.int64()), "text": [t for _, t in items]}))
    assert sorted(c.sql(op5_decontamination.SQL).fetchall(), key=str) == out
    assert op5_decontamination.contained_items(empty, b).count() == 0 and op5_decontamination.contained_items(d, b.limit(0)).count() == 0


def test_leaks_of_any_item(spark, tmp_path):
    """Shorter texts of an id that repeats, texts without an id and short items are searched too."""
    a, b, c = ("one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen", "red green blue yellow pink")
    spark.createDataFrame([(1, a), (1, b), (None, c), (None, None), (2, "Too short!"), (3, "alone"), (4, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, f"x {a} y"), (2, f"x {b} y"), (3, f"x {c} y"), (4, "it is too short."), (5, "too, and short"), (6, "alone"), (7, None), (8, "nine ten eleven"), (9, "too")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in pipeline.decontamination(spark, docs, str(tmp_path)).collect()} == {5, 7, 8, 9}


def test_pii(spark, empty, monkeypatch):
    t = 'mail Anna.B@Mail.example.com or ANNA.B@MAIL.EXAMPLE.COM, +1 (555) 010-9999, 10.0.0.7, 4111 1111 1111 1111, 4111111111111111, DE89 3704 0044 0532 0130 00, token = "0123456789abcdef0123". Dr. Anna Vogt; Ms. Vogt. Господин Иванов'
    d = spark.createDataFrame([(1, t, "k", "s", None), (1, t, "k", "s", None), (2, None, "", "", ""), (3, "version 2.0, nothing here", "", "", "")], SCHEMA)
    rows = op6_pii_surrogates.redacted(d).collect()
    assert rows[0].text == rows[1].text and rows[2].text is None and rows[3].text == "version 2.0, nothing here" and [r.n_entities for r in rows[2:]] == [0, 0] and rows[0].lang == "k"
    new = rows[0].text
    for secret in ("Anna", "ANNA", "ail.ex", "010-9999", "0.0.7", "1111 1111", "3704", "0123456789abcdef", "Vogt", "Иванов"):
        assert secret not in new
    a, b = re.search(r"mail (\S+) or (\S+),", new).groups()
    assert a.lower() == b.lower() and b.isupper()
    card, plain = re.search(r"(\d{4} \d{4} \d{4} \d{4}), (\d{16})", new).groups()
    assert card.replace(" ", "") == plain and plain[0] == "4" and op6_pii_surrogates.luhn(plain) == 0
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}, 10\.\d+\.\d+\.\d+,", new)
    first, last, again = re.search(r"Dr\. (\w+) (\w+); Ms\. (\w+)\.", new).groups()
    assert last == again and first.endswith("a") and re.search("Господин [А-Я][а-я]+$", new)
    assert op6_pii_surrogates.redacted(empty).count() == 0
    # surrogates from a small space collide, and still become distinct, by either way of passing exceptions
    tight = lambda kind, value, attempt=0, key=b"": str(zlib.crc32(f"{value} {attempt}".encode()) % 400)
    monkeypatch.setattr(op6_pii_surrogates, "surrogate", tight)
    found = spark.createDataFrame([("x", str(1000 + i)) for i in range(60)], "kind string, value string")
    odd = {r.value: r.attempt for r in op6_pii_surrogates.exceptions(found, b"").collect()}
    made = [tight("x", str(1000 + i), odd.get(str(1000 + i), 0)) for i in range(60)]
    assert len(set(made)) == 60 and odd


def test_pii_small_spaces(spark):
    """More entities than their own shape has surrogates for."""
    words = [*(f"{c}@one.example.com" for c in "abcdefghijklmnopqrst"), *(f"someone@{c}.com" for c in "abcdefghijklmnopqrst"), "password=------------", *(f"_{i}@x.example.org" for i in range(8))]
    d = spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(words)], SCHEMA)
    new = [r.text for r in op6_pii_surrogates.redacted(d).collect()]
    assert len(set(new)) == len(words) and not set(new) & set(words)
    domains = [t.split("@")[1] for t in new[20:40]]
    assert len({*domains, *(t.split("@")[1] for t in words[20:40])}) == 40
    places = [{".".join(op6_pii_surrogates.surrogate("ip", ip, k).split(".")[:2]) for k in range(16)} for ip in ("192.168.3.4", "172.16.9.9")]
    assert {"192.168", "172.16"} & places[0] == {"192.168"} and all(len(p) > 8 and any(x.startswith("10.") for x in p) for p in places)
    assert op6_pii_surrogates.written("+1 23-45", "phone", "198765") == "+1 98-765"


def test_pii_names(spark):
    """A name that a text gives away is replaced wherever it stands, by one surrogate."""
    t = "Dr. Anna Vogt came. Vogt left. Anna stayed. VOGT's car. Priya Raman called, and Raman's boss. Miss The; 王小明先生, 김민수 씨, Κύριος Παπάς, السيد أحمد"
    new = op6_pii_surrogates.redacted(spark.createDataFrame([(t,)], "text string"), key=b"k").first().text
    for name in ("Anna", "Vogt", "VOGT", "Priya", "Raman", "王小明", "김민수", "Παπάς", "أحمد"):
        assert name not in new
    m = re.match(r"Dr\. (\w+) (\w+) came\. (\w+) left\. (\w+) stayed\. (\w+)'s car\. (\w+) (\w+) called, and (\w+)'s boss\. Miss The;", new)
    assert m[2] == m[3] == m[5].title() and m[1] == m[4] and m[5].isupper() and m[7] == m[8]
    assert re.search(r"[一-鿿]{3}先生, [가-힣]{3} 씨, Κύριος [Α-Ω][α-ω]+, السيد [؀-ۿ]+$", new)


def test_pii_formats(spark):
    """One surrogate for a number or an address in all its formats."""
    t = "+1 555 010 9999|(555) 010-9999|555-010-9999|+15550109999|Anna.B@Mail.example.com|ANNA.B@MAIL.EXAMPLE.COM|anna.b@mail.example.com"
    a, b, c, d, e, f, g = op6_pii_surrogates.redacted(spark.createDataFrame([(t,)], "text string"), key=b"k").first().text.split("|")
    digits = lambda x: re.sub(r"\D", "", x)
    assert digits(a) == digits(d) == "1" + digits(b) == "1" + digits(c) and re.fullmatch(r"\(\d{3}\) \d{3}-\d{4}", b) and "5550109999" not in digits(a)
    assert e.lower() == f.lower() == g and f.isupper() and e[0].isupper() and e[5].isupper() and e[1].islower()


def test_pii_cards():
    """Only numbers that pass the Luhn check are card numbers."""
    found = lambda t: [(k, v) for _, _, k, v in op6_pii_surrogates.mentions(t)]
    assert found("4111 1111 1111 1111, 4111111111111111, 378282246310005") == [("card", "4111111111111111")] * 2 + [("card", "378282246310005")]
    assert found("id 4111111111111112, 4111-1111-1111-1112, 378282246310006, 41111111111111111") == []


def test_pii_on_a_table(spark, docs):
    """No entity of the corpus stays, surrogates are distinct and never real, mentions agree, and the rest of each text is as it was."""
    simple = re.compile(r"[\w.+-]+@[\w.-]+\.\w+|\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])|\b4\d{15}\b")
    block = spark.createDataFrame([(10_000 + i, f"hosts 192.168.{i % 4}.{i // 4} and {chr(97 + i % 26)}@example.com {i % 26}") for i in range(900)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionAll(block)
    rows = {r.doc_id: r for r in both.collect()}
    out = {r.doc_id: r for r in op6_pii_surrogates.redacted(both, key=b"k").collect()}
    real = {x.lower() for r in rows.values() for x in simple.findall(r.text or "")}
    assert len(real) > 900
    to = collections.defaultdict(set)
    for d, r in out.items():
        old, new = simple.findall(rows[d].text or ""), simple.findall(r.text or "")
        assert len(old) == len(new)
        for x, y in zip(old, new):
            to[x.lower()].add(y.lower())
        if not op6_pii_surrogates.mentions(rows[d].text or ""):
            assert r.text == rows[d].text and r.n_entities == 0
    assert all(len(v) == 1 for v in to.values())
    given = [next(iter(v)) for v in to.values()]
    assert len(set(given)) == len(given) and not set(given) & real


def test_pii_key(spark):
    d = spark.createDataFrame([("a@b.example.com",)], "text string")
    with_key = lambda k: op6_pii_surrogates.redacted(d, key=k).first().text
    assert with_key(b"a") == with_key(b"a") != with_key(b"b")
    mine = op6_pii_surrogates.surrogate_key(spark)
    assert mine == op6_pii_surrogates.surrogate_key(spark)
    spark.conf.set(op6_pii_surrogates.KEY_SETTING, "x")
    try:
        assert op6_pii_surrogates.surrogate_key(spark) != mine
    finally:
        spark.conf.unset(op6_pii_surrogates.KEY_SETTING)


def test_pii_many_exceptions(spark, monkeypatch):
    d = spark.createDataFrame([(i, f"call +1 (555) 010-{1000 + i} now", "", "", "") for i in range(20)], SCHEMA)
    plain = {r.doc_id: r.text for r in op6_pii_surrogates.redacted(d).collect()}
    odd = spark.createDataFrame([("phone", f"15550101{i:03d}", 3) for i in range(10)], "kind string, value string, attempt int")
    monkeypatch.setattr(op6_pii_surrogates, "exceptions", lambda found, key: odd)
    few = {r.doc_id: r.text for r in op6_pii_surrogates.redacted(d).collect()}
    monkeypatch.setattr(op6_pii_surrogates, "EXCEPTIONS", 1)
    many = {r.doc_id: r.text for r in op6_pii_surrogates.redacted(d).collect()}
    assert few == many and sum(few[i] != plain[i] for i in range(20)) == 10


def ids_of(t):
    return units.byte_bpe(BPE).encode(t, add_special_tokens=False).ids


def test_packing(spark, odd, empty, docs):
    for df in (odd, docs):
        rows = op7_packing.packed(df, BPE).collect()
        want = collections.Counter()
        for (d, t), n in texts(df).items():
            want[(d, len(ids_of(t)) + 1, zlib.crc32(np.array([*ids_of(t), 1], "<u4")[:2048].tobytes()))] += n
        assert collections.Counter((r.doc_id, r.doc_tokens, r.ids_crc32) for r in rows if r.start == 0) == want
        assert sum(r.length for r in rows) == sum(n * k for (_, n, _), k in want.items())
        by = collections.defaultdict(list)
        for r in rows:
            by[r.sequence_id].append((r.offset, r.length))
        for seq in by.values():
            at = 0
            for offset, length in sorted(seq):
                assert offset == at
                at += length
            assert at <= 2048
        if df is docs:  # next to no padding: the last sequence of each pattern that has to end early
            assert 2048 * len(by) - sum(r.length for r in rows) < 0.02 * 2048 * len(by)
    assert op7_packing.packed(empty, BPE).count() == 0


LONG = {"spaces": " " * 1_000_000, "lines": "\n" * 1_000_000, "mixed": " \n\t" * 50_000 + "x " * 20 + "\u3000" * 20_000, "no space": "abcdefghij" * 300_000, "cut": "some words, here and there\n " * 90_000, "special": "a <|endoftext|> " * 90_000, "beyond Latin": "текст и слова " * 90_000}


@pytest.mark.parametrize("name", LONG)
def test_ids_of_long_texts(name):
    assert units.same_ids(BPE)
    assert units.encoder(BPE, True).one(LONG[name]) == np.array(ids_of(LONG[name]), "<u4").tobytes()


def test_ids_of_other_tokenizers():
    """What a faster encoder can't give goes to the library."""
    other = public_tokenizers.path("word_bpe_49k.json")
    assert not units.same_ids(other)
    assert units.encoder(other, False).one("Some words") == np.array(units.byte_bpe(other).encode("Some words", add_special_tokens=False).ids, "<u4").tobytes()


def test_best_multiset():
    random.seed(3)
    for _ in range(200):
        counts = {random.randint(1, 20): random.randint(1, 4) for _ in range(5)}
        sums = {0}
        for n, k in counts.items():
            sums = {s + n * i for s in sums for i in range(k + 1)}
        used = op7_packing.best_multiset(counts, 37)
        assert sum(n * k for n, k in used.items()) == max(s for s in sums if s <= 37) and all(k <= counts[n] for n, k in used.items())


def test_huffman(spark, odd, empty, docs, tmp_path):
    for name, df in (("odd", odd), ("docs", docs), ("empty", empty)):
        table = op8_huffman_output.token_table(df, BPE, ranges=3)
        lengths = op8_huffman_output.code_lengths(op8_huffman_output.id_counts(table, BPE))
        op8_huffman_output.write_files(table, BPE, lengths, f"{tmp_path}/{name}")
        rows = sorted(op8_huffman_output.read_files(spark, f"{tmp_path}/{name}", with_ids=True).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in rows] == sorted((r.doc_id for r in df.collect()), key=lambda d: (d is not None, d or 0))
        want, at = collections.Counter((r.doc_id, *ids_of(r.text or ""), 2) for r in df.collect()), 0
        for r in rows:
            ids = np.frombuffer(r.ids, "<u4")
            want[(r.doc_id, *ids.tolist())] -= 1
            assert r.start == at and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(r.ids)
            at += len(ids)
        assert not any(want.values())


def test_huffman_hot_ids(spark):
    """Rows of one id, or of none, spread over shards."""
    d = spark.range(4_000, numPartitions=8).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    sizes = [r["count"] for r in op8_huffman_output.token_table(d, BPE, ranges=16).groupBy("shard").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 800


def test_huffman_lengths():
    counts = np.array([0, *(1 << i for i in range(30))])
    lengths = op8_huffman_output.code_lengths(counts)
    assert lengths.max() == 16 and lengths[0] == 0 and sum(2.0 ** -int(n) for n in lengths if n) <= 1
    ids = np.array([30, 1, 29, 2, 30] * 700, np.uint32)
    block = op8_huffman_output.encode_block([(5, ids), (None, ids[:1])], lengths, op8_huffman_output.canonical(lengths))
    out = op8_huffman_output.decode_block(block)
    assert [d for d, _ in out] == [5, None] and (out[0][1] == ids).all() and out[1][1].tolist() == [30]


def test_huffman_many_ids():
    """More ids than codes of 16 bits."""
    rng = np.random.default_rng(3)
    ids = np.concatenate([np.arange(100_000), rng.integers(0, 100_000, 5_000)]).astype(np.uint32)
    lengths = op8_huffman_output.code_lengths(np.bincount(ids))
    assert lengths.max() == 17 and abs(sum(2.0 ** -int(n) for n in lengths) - 1) < 1e-12
    block = op8_huffman_output.encode_block([(1, ids)], lengths, op8_huffman_output.canonical(lengths))
    assert (op8_huffman_output.decode_block(block)[0][1] == ids).all()


def test_language(spark, docs, odd, empty):
    profiles = op9_language_id.language_profiles(docs)
    out = op9_language_id.identified(docs, profiles, ["doc_id", "lang", "text"]).collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.98
    got = op9_language_id.identified(odd, profiles, odd.columns[:2]).collect()
    assert [(r.lang_pred, r.score, r.rejected) for r in got if not r.text or r.text == " "] == [("und", 0.0, True)] * 3
    assert op9_language_id.identified(empty, profiles).count() == 0 and op9_language_id.language_profiles(empty) == {}
    assert {r.lang_pred for r in op9_language_id.identified(docs.limit(3), {}).collect()} == {"und"}
    got = op9_language_id.identified(spark.createDataFrame([(x,) for x in ("½ ²", "Ⅷ ①", "12 _ 3", "½a")], "text string"), profiles).collect()
    assert [r.lang_pred == "und" for r in got] == [True, True, True, False]
    kept = op9_language_id.identified(odd, profiles, odd.columns)
    assert kept.columns == ["doc_id", "text", "lang", "key", "lang_pred", "score", "rejected"] and kept.count() == odd.count()


def test_language_by_hand():
    """Profiles and out-of-place distances in plain Python."""
    rng = random.Random(6)
    def ranked(t):
        n = collections.Counter()
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            for k in (1, 2, 3):
                for i in range(len(w) + 3 - k):
                    if (g := f" {w} "[i : i + k]) != " ":
                        n[g] += 1
        return sorted(n, key=lambda g: (-n[g], sum(ord(c) << 21 * (len(g) - 1 - j) for j, c in enumerate(g))))[: op9_language_id.PROFILE]
    letters = {"aa": "abcdefghij", "bb": "fghijklmnop", "cc": "klmnopqrstuvwxyzä"}
    make = lambda k, n: " ".join("".join(rng.choices(letters[k], k=rng.randint(1, 9))) for _ in range(n))
    own = {k: make(k, 900) for k in letters}
    p = op9_language_id.Profiles({k: op9_language_id.profile(t).tolist() for k, t in own.items()})
    place = {k: {g: i for i, g in enumerate(ranked(t))} for k, t in own.items()}
    for _ in range(60):
        t = make(rng.choice(list(letters)), 3) + " " + make(rng.choice(list(letters)), rng.randint(1, 40))
        mine = ranked(t)
        apart = {k: sum(abs(at[g] - i) if g in at else op9_language_id.PROFILE for i, g in enumerate(mine)) for k, at in place.items()}
        (best, lang), (other, _) = sorted((v, k) for k, v in apart.items())[:2]
        got = p.nearest(op9_language_id.profile(t))
        assert got[0] == lang and abs(got[1] - other / (best + other)) < 1e-12


def test_language_many(spark):
    """No language is left out, and rows that share an id are sampled one by one."""
    hot = next(i for i in range(1, 99) if zlib.crc32(str(i).encode()) % 3 != 1)
    rows = [(0, f"{chr(0x4E00 + i)}{chr(0x5E00 + i)} " * 3, f"l{i}") for i in range(1_200)] + [(hot, "same words here", "hot")] * 3_000
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(op9_language_id.language_profiles(d)) == 1_201


def brute_classes(rows):
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, t in rows if (w := re.findall(r"[^\W_]+", (t or "").lower()))}
    label = {d: d for d, _ in rows}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    return label


def test_near_dedup(spark, odd, empty):
    random.seed(5)
    words = ["".join(random.choices("abcdefgh", k=4)) for _ in range(2_000)]
    rows = []
    for g in range(12):
        base = random.choices(words, k=random.choice([30, 120, 400]))
        for _ in range(random.choice([1, 2, 40])):
            t = list(base)
            for _ in range(random.randint(0, max(1, len(t) // 25))):
                t[random.randrange(len(t))] = random.choice(words)
            rows.append((len(rows), " ".join(t)))
    rows += [(len(rows), rows[3][1]), (len(rows) + 1, rows[3][1].upper() + "!")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in op10_near_dedup.classes(df).collect()} == brute_classes(rows)
    got = {r.doc_id: r.class_id for r in op10_near_dedup.classes(odd).collect()}
    assert got[None] is None and got[9] == 8 and got[0] == 0 and len(got) == 12
    assert op10_near_dedup.classes(empty).count() == 0


def test_near_dedup_family(spark):
    """A family that shares a template and is below 0.8 itself hides pairs that are just over it."""
    rng = random.Random(7)
    fresh = lambda n: [f"w{rng.getrandbits(48):x}" for _ in range(n)]
    template, rows = fresh(300), []
    for i in range(600):
        own = fresh(12)
        for _ in range(2 if i < 150 else 1):
            rows.append((len(rows), " ".join(template + own + fresh(38))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    assert sum(d != c for d, c in want.items()) == 150
    assert {r.doc_id: r.class_id for r in op10_near_dedup.classes(df).collect()} == want


def test_near_dedup_repeats(spark):
    """Copies that differ in how often their five-grams stand there, and in little else."""
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.getrandbits(48):x}" for _ in range(n)]
    rows = []
    for _ in range(30):
        t = fresh(400)
        rows += [(len(rows), " ".join(t)), (len(rows) + 1, " ".join(t + fresh(50) + t[:150] * 100))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in op10_near_dedup.classes(df).collect()} == {d: d - d % 2 for d, _ in rows}


def test_signature_estimates():
    rng = np.random.default_rng(2)
    e = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    agree = []
    for _ in range(12):
        e = op10_near_dedup.mix(e)
        agree.append(np.mean(op10_near_dedup.signature(e[:800], np.ones(800)) == op10_near_dedup.signature(e[100:], np.ones(800))))
    assert abs(np.mean(agree) - 700 / 900) < 0.04
    w = rng.uniform(1, 5, 800)
    assert (op10_near_dedup.signature(e[:800], w) == op10_near_dedup.signature(e[:800], w * 3)).all()


def test_pipeline(spark):
    """Against a brute-force version of what the stages decide."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    label = brute_classes([(d, r.text) for d, r in rows.items()])
    leaks = {r.doc_id for r in op5_decontamination.contained_items(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    kept = {d for d in rows if label[d] == d and d not in leaks}
    out = pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in out} == kept
    lengths = collections.Counter()
    for r in out:
        lengths[r.doc_id] += r.length
    assert all(lengths[r.doc_id] == r.doc_tokens for r in out)
    clean = [d for d in kept if not op6_pii_surrogates.mentions(rows[d].text)]
    assert clean and all(lengths[d] == len(ids_of(rows[d].text)) + 1 for d in clean)


def test_pipeline_rows_without_id(spark, tmp_path):
    """A leak goes whether its row has an id or not; null texts and clean texts stay."""
    item = "one two three four five six seven eight nine ten eleven twelve"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"so: {item} end", "en", "s", 1), (None, "clean words here", "en", "s", 1), (None, None, "en", "s", 1), (4, item, "en", "s", 1), (5, "other", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = pipeline.decontamination(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert {(r.doc_id, r.text) for r in out.collect()} == {(None, "clean words here"), (None, None), (5, "other")} and out.count() == 3


def test_pipeline_rows_that_share_ids(spark, tmp_path):
    """Rows count, not ids: different texts of one id stay, copies go whatever their ids, and a leak takes no other row."""
    rng = random.Random(9)
    a, b, c, d, e = (" ".join(f"w{rng.getrandbits(48):x}" for _ in range(80)) for _ in range(5))
    rows = [(7, a), (7, b), (2, a), (3, b), (7, c), (None, c), (None, d), (None, d), (None, d + " more"), (7, e), (8, e), (7, e), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert texts(out) == collections.Counter([(2, a), (3, b), (7, c), (None, d), (7, e), (None, ""), (None, "")])
    spark.createDataFrame([(1, a)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert texts(pipeline.decontamination(spark, docs, str(tmp_path))) == collections.Counter((i, t or "") for i, t in rows if t != a)
