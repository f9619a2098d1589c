"""Hand-made cases of the web-data functions and operators, and every query against its SQL."""

import base64
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidewater.functions import html, http, urls
from tidewater.operators import catalog, lookups, rules, state
from tidewater.plans import registry
from tidewater.sources import files

DATA = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.sql(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{t}')")
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = lambda r: sorted(tuple(map(str, x)) for x in r)
    quoted = ", ".join(f'"{x}"' for x in cols)
    assert sorted(c.sql(registry.ORACLES[name]).columns) == cols
    assert rows(df.select(*cols).collect()) == rows(c.sql(f"select {quoted} from ({registry.ORACLES[name]})").fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())


def test_xor_round_trip(spark):
    for t in ("", "a", "abc", "https://é.example/日本?😀"):
        assert one(spark, urls.xor_units(urls.xor_units(F.lit(t)))) == t
    assert one(spark, urls.xor_encode(F.lit("abcd"))) == "a%60cf"
    assert one(spark, urls.xor_decode(F.lit("a%60cf?q=1"))) == "abcd?q=1"


def test_uri_encode(spark):
    assert one(spark, urls.uri_encode(F.lit("a b+c!'()*~/é"))) == "a%20b%2Bc!'()*~%2F%C3%A9"


@pytest.mark.parametrize(("ref", "out"), [("x.js", "https://h.example/a/x.js"), ("/x", "https://h.example/x"), ("//o/p", "https://o/p"), ("?q", "https://h.example/a/b?q"), ("#t", "https://h.example/a/b?z#t"), ("../c/./d", "https://h.example/c/d"), ("http://k/", "http://k/")])
def test_resolve(spark, ref, out):
    assert one(spark, urls.resolve(F.lit("https://h.example/a/b?z"), F.lit(ref))) == out


def test_url_forms(spark):
    assert one(spark, urls.normalize(F.lit(" some words "), "s:")) == "s:some words"
    assert one(spark, urls.normalize(F.lit("a.example"), "s:")) == "https://a.example"
    assert one(spark, urls.replace_first(F.lit("aXbX"), "X", F.lit("-"))) == "a-bX"
    assert one(spark, urls.registrable_domain(F.lit("a.b.example.com"))) == "example.com"
    assert one(spark, urls.registrable_domain(F.lit("localhost"))) == "localhost"
    assert one(spark, urls.redirect_target(F.lit("GET"), F.lit("https://h/r?url=http%3A%2F%2Fk"), F.lit(None).cast("string")))["target"] == "http://k"
    assert one(spark, urls.redirect_target(F.lit("PUT"), F.lit("https://h/r"), F.lit("x")))["status"] == 405
    assert one(spark, urls.proxy_encode(F.lit("data:x"), F.lit("https://h/"), "https://s", "/p/")) == "data:x"


def test_cookies(spark):
    assert one(spark, http.cookies(F.lit('a=1; b="x%20y"; a=2; c'))) == {"a": "1", "b": "x y"}
    assert [tuple(p) for p in one(spark, http.naive_cookies(F.lit("a=1=2;b=3")))] == [("a", "1"), ("b", "3")]
    assert one(spark, http.split_set_cookie(F.lit("a=1; Expires=Wed, 21 Oct 2025 07:28:00 GMT, b=2"))) == ["a=1; Expires=Wed, 21 Oct 2025 07:28:00 GMT", "b=2"]
    c = one(spark, http.set_cookie(F.lit("a=x=y; Path=/; Secure")))
    assert (c["name"], c["value"], c["attributes"]) == ("a", "x=y", {"path": "/", "secure": ""})
    assert one(spark, http.serialize_cookie(F.lit("a"), F.lit("1"), F.lit("/"), F.lit(None).cast("string"), F.lit(True))) == "a=1; Path=/; Secure"
    assert one(spark, http.serialize_cookie(F.lit("a b"), F.lit("1"), F.lit("/"), F.lit("x"), F.lit(True))) is None


def test_headers(spark):
    h = F.create_map(F.lit("Host"), F.lit("a"), F.lit("X-Frame"), F.lit("b"))
    assert one(spark, http.lower_keys(h)) == {"host": "a", "x-frame": "b"}
    assert one(spark, http.lower_keys(F.create_map(F.lit("Host"), F.lit("a"), F.lit("host"), F.lit("b")))) == {"host": "b"}
    assert one(spark, http.set_cookie(F.lit("a=1; path=/x; Path=/y")))["attributes"] == {"path": "/y"}
    assert one(spark, http.drop_headers(h, ["x-frame"])) == {"Host": "a"}
    assert one(spark, http.with_headers(h, host=F.lit("z"), cookie=F.lit(None).cast("string"))) == {"X-Frame": "b", "host": "z"}
    assert one(spark, http.rewrite_header(h, "host", F.upper)) == {"Host": "A", "X-Frame": "b"}
    assert one(spark, http.is_token(F.lit("a:b"))) is False
    text = "x" * 7000
    assert [len(p["part"]) for p in one(spark, http.chunks(F.lit(text)))] == [3072, 3072, 856]
    assert one(spark, http.rejoin(F.reverse(http.chunks(F.lit(text))))) == text


def test_codecs(spark):
    salt = F.unhex(F.lit("0102030405060708"))
    e = http.aes_encrypt(F.lit("hé"), F.lit("pw"), salt)
    assert base64.b64decode(one(spark, e))[:16] == b"Salted__" + bytes(range(1, 9))
    assert one(spark, http.aes_decrypt(e, F.lit("pw"))) == "hé"
    assert one(spark, http.base64_latin1(F.lit("é"))) == "6Q==" and one(spark, http.base64_latin1(F.lit("日"))) is None
    assert one(spark, http.base64_lines(F.lit("a" * 130))) == "\n".join(["a" * 64, "a" * 64, "a" * 2])


def test_html(spark):
    up = lambda c: F.upper(c)
    assert one(spark, html.rewrite_srcset(F.lit("a.png 1x, b.png 2x"), up)) == "A.PNG 1x, B.PNG 2x"
    assert one(spark, html.rewrite_css(F.lit("a{b:url('x')} c{d:url(y)}"), up)) == "a{b:url(X)} c{d:url(Y)}"
    assert one(spark, html.inject_head(F.lit("<!doctype html><html>x"), "<i>$1")) == "<!doctype html><i>$1<html>x"
    assert one(spark, html.rename_attribute(F.lit('<script nonce="a"><p nonce="b">'), "nonce", "data-nonce")) == '<script data-nonce="a"><p nonce="b">'
    m = json.loads(one(spark, html.rewrite_manifest(F.lit('{"name":"n","start_url":"/a","icons":[{"src":"i"}],"serviceworker":{}}'), up, "!")))
    assert m == {"name": "n!", "start_url": "/A", "icons": [{"src": "I"}]}
    assert one(spark, html.attributes(F.lit("<a data-href=\"x\" HREF='y' href=z> href=\"no\""), "href")) == ["y", "z"]


def test_catalog(spark, tmp_path):
    records = [{"name": "Éclair", "categories": ["all", "local"], "error": True}, {"name": "apple", "categories": ["all"], "link": "https://x.test/", "partial": "false"}, {"name": "[Custom] z", "categories": ["all"], "links": [{"name": "p", "url": "u1"}, {"name": "q", "url": "u2"}]}, {"name": "Zebra", "categories": ["all", "game"], "link": "https://y.test/"}]
    (tmp_path / "a.json").write_text(json.dumps(records, indent=1))
    c = files.read_catalog(spark, str(tmp_path / "a.json"))
    o = catalog.ordered(c)
    assert [r.name for r in o.orderBy("ordinal").collect()] == ["[Custom] z", "apple", "Éclair", "Zebra"]
    a = {r.name: r for r in catalog.with_availability(c, ["x.test"], ["y.test"], "P", "E").select("name", "local", "partial", "error", "say", catalog.action().alias("act")).collect()}
    assert (a["Éclair"].local, a["apple"].partial, a["apple"].say, a["Zebra"].error, a["Zebra"].say, a["Éclair"].act) == ("true", "false", None, "true", "E", "local")
    links = {r.name: (r.a, r.b) for r in c.select("name", catalog.effective_link(F.lit("2x")).alias("a"), catalog.effective_link(F.lit("9")).alias("b")).collect()}
    assert links["[Custom] z"] == ("u2", None) and links["apple"] == ("https://x.test/",) * 2
    assert c.filter("links is not null").select(catalog.menu(F.col("links")).alias("m")).first().m == "1: p\n2: q"
    assert {r.name for r in catalog.in_categories(c, ["game", "local"]).collect()} == {"Éclair", "Zebra"}
    assert one(spark, catalog.toggle(F.array(*map(F.lit, [1, 2, 1])), F.lit(1))) == [2, 1]
    assert one(spark, catalog.move(F.array(*map(F.lit, "abcd")), F.lit("a"), F.lit("c"))) == ["b", "c", "a", "d"]
    assert one(spark, catalog.move(F.array(*map(F.lit, "abcd")), F.lit("d"), F.lit("b"))) == ["a", "d", "b", "c"]


def test_lookups(spark):
    types = spark.createDataFrame([(0, "application/octet-stream", "iana", ["bin", "x"]), (1, "text/x", "apache", ["x"]), (2, "application/x", "iana", ["y"]), (3, "text/y", "iana", ["y"]), (4, "a/z", "iana", ["z"]), (5, "b/z", "iana", ["z"])], "ordinal long, type string, source string, extensions array<string>")
    assert {r.extension: r.type for r in lookups.best_by_extension(types).collect()} == {"bin": "application/octet-stream", "x": "text/x", "y": "application/x", "z": "b/z"}
    octets = spark.createDataFrame([(0, "application/java", "apache", ["o"]), (1, "application/octet-stream", "iana", ["o"])], types.schema)
    assert lookups.best_by_extension(octets).first().type == "application/octet-stream"
    log = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "a", None)], "seq long, key string, value string")
    assert [tuple(r) for r in lookups.last_write(log).collect()] == [("b", "y")]
    assert one(spark, lookups.pick(["a", "b"], F.lit(0.99))) == "b"


def test_state(spark):
    tabs = spark.createDataFrame([("s", 1, "create", "a", None), ("s", 2, "create", "b", None), ("s", 3, "create", "c", None), ("s", 4, "reorder", "c", "a"), ("s", 5, "close", "c", None)], "session string, seq long, action string, tab_id string, target_id string")
    assert [tuple(r) for r in state.tabs(tabs).collect()] == [("s", ["a", "b"], "a")]
    keys = spark.createDataFrame([("s", i, k) for i, k in enumerate("aabaaa")], "s string, i long, k string")
    assert state.sequence_matches(keys, "s", ["i"], "k", ["a", "a"]).first().matches == 2
    jar = spark.createDataFrame([(1, "h.x", None, "n", "1", None), (2, "h.x", ".x", "m", "2", None), (3, "h.x", None, "n", "3", "2020-01-01 00:00:00")], "seq long, host string, domain string, name string, value string, expires string").withColumn("expires", F.to_timestamp("expires"))
    assert [tuple(r)[:3] for r in state.cookie_jar(jar, "2024-01-01").collect()] == [("x", "m", "2")]
    assert one(spark, state.tab_title(F.lit("a"))) == "Tab"


def test_folds_over_many_blocks(spark):
    """Against plain loops, for keys that lie in one block and in several, with ties and nulls."""
    import random

    random.seed(4)
    rows = [(k, random.randint(0, 60) if k != "hot" else i // 3, random.choice("aab")) for k, n in (("hot", 900), ("x", 30), ("y", 1), (None, 5)) for i in range(n)] + [("none", None, "a")]
    events = spark.createDataFrame([(k, i, t, v) for i, (k, t, v) in enumerate(rows)], "k string, i long, t long, v string").withColumn("ts", F.timestamp_seconds("t"))
    ttl, seq = {}, {}
    for k in {r[0] for r in rows}:
        at, hits, misses = None, 0, 0
        for t in sorted(t for x, t, _ in rows if x == k and t is not None):
            at, hits, misses = (at, hits + 1, misses) if at is not None and t - at <= 7 else (t, hits, misses + 1)
        last, n = [], 0
        for x, _, v in rows:
            if x == k:
                last = [*last, v][-3:]
                last, n = ([], n + 1) if last == ["a", "b", "a"] else (last, n)
        ttl[k], seq[k] = (hits, misses), n
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        for on in ("true", "false"):
            spark.conf.set("spark.sql.adaptive.enabled", on)
            assert {r.k: (r.hits, r.misses) for r in state.ttl_cache(events, "k", "ts", 7).collect()} == ttl
            assert {r.k: r.matches for r in state.sequence_matches(events, "k", ["i"], "v", ["a", "b", "a"]).collect()} == seq
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert state.ttl_cache(events.limit(0), "k", "ts", 7).count() == state.sequence_matches(events.limit(0), "k", ["i"], "v", ["a"]).count() == 0


def test_streams_equal_batch(spark, tmp_path):
    from tidewater.streaming import state as streams

    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, df, want in (("ttl", streams.ttl_cache(stream, "user_id", "ts", 86_400), state.ttl_cache(events, "user_id", "ts", 86_400)), ("seq", streams.sequence_matches(stream, "user_id", "event_id", "event_type", ["view", "view"]), state.sequence_matches(events, "user_id", ["event_id"], "event_type", ["view", "view"]))):
        q = df.writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, want.collect()))


def test_streams_of_logs(spark, tmp_path):
    """Tabs and the cookie jar, in two micro-batches, as their batch folds; sequences with nulls and odd characters."""
    import random

    from tidewater.streaming import state as streams

    rng = random.Random(2)
    none = lambda x: rng.choice([x, x, None])
    logs = {
        "tabs": ("session string, seq long, action string, tab_id string, target_id string", [("s" + str(i % 5), i, rng.choice(["create", "switch", "close", "reorder", "x"]), rng.choice("abcd"), none(rng.choice("abcd"))) for i in range(300)]),
        "jar": ("seq long, host string, domain string, name string, value string, expires timestamp", [(i, "h" + str(i % 4), none(".d.test"), rng.choice("abc"), str(i), none(__import__("datetime").datetime(rng.choice([2020, 2030]), 1, 1))) for i in range(200)]),
        "seq": ("s string, i long, v string", [("k", i, rng.choice(["a", "", None, "x\0y"])) for i in range(300)]),
    }
    for name, (schema, rows) in logs.items():
        half = len(rows) // 2
        for i, part in enumerate((rows[:half], rows[half:])):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        whole = spark.createDataFrame(rows, schema)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        df = {"tabs": lambda d: streams.tabs(d), "jar": lambda d: streams.cookie_jar(d, "2024-01-01"), "seq": lambda d: streams.sequence_matches(d, "s", "i", "v", ["", "x\0y"])}[name](stream)
        q = df.writeStream.outputMode("update").foreachBatch(lambda b, i, name=name: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(str(tmp_path / f"{name}-out"))).option("checkpointLocation", str(tmp_path / f"{name}-at")).start()
        q.processAllAvailable()
        q.stop()
        out = spark.read.parquet(str(tmp_path / f"{name}-out"))
        key = out.columns[0]
        last = {r[0]: tuple(r)[1:-1] for r in out.orderBy("batch").collect()}
        if name == "tabs":
            assert last == {r.session: (",".join(r.tabs), r.active) for r in state.tabs(whole).collect()}
        elif name == "jar":
            want = {}
            for r in state.cookie_jar(whole, "2024-01-01").orderBy("name").collect():
                want.setdefault(r.host, []).append(f"{r.name}={r.value}")
            assert {k: v[0] for k, v in last.items() if v[0]} == {k: "; ".join(v) for k, v in want.items()}
        else:
            assert last["k"][0] == sum(1 for _ in __import__("re").finditer("1x", "".join({"": "1", "x\0y": "x"}.get(v, "-") for _, _, v in rows)))
        assert key in ("session", "host", "s")


def test_save_file(spark):
    text = files.save_text(F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("k"), F.lit("v")))
    cookies, storage = files.load_save(text, F.create_map(F.lit("a"), F.lit("0"), F.lit("b"), F.lit("2")), F.create_map(F.lit("z"), F.lit("y")))
    assert one(spark, cookies) == {"b": "2", "a": "1"} and one(spark, storage) == {"z": "y", "k": "v"}


def test_rules(spark):
    path = lambda p, c: one(spark, rules.dynamic_route(F.lit(p), F.lit(c).cast("string"), "/a/q/", "/ca/"))
    assert (path("/a/q/x", None), path("/x", "/a/q/y"), path("/ca/", "/a/q/y"), path("/x", None)) == (True, True, False, False)
    assert one(spark, rules.visible_names(F.array(*map(F.lit, ["a", "b", "a"])), ["b"])) == ["a", "a"]
    for name in rules.CODECS:
        encode, decode = rules.codec(name)
        assert one(spark, decode(encode(F.lit("a b/é")))) == "a b/é"
    store = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    assert rules.stored_rows(store, "a").count() == rules.stored_rows(store, value="2").count() == 1 and rules.cleared(store).count() == 0
    assert lookups.add_absent(store, store.limit(1).withColumn("key", F.lit("c"))).count() == 3
    assert rules.hooked(store, [lambda d: None, lambda d: d.limit(0)], first_only=True).count() == 2
    assert rules.hooked(store, [lambda d: None, lambda d: d.filter("key = 'a'")]).count() == 1
    assert rules.ok_only(spark.createDataFrame([(200,), (304,)], "status int")).count() == 1
