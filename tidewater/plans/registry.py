"""The queries of the web-data toolkit over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, http, urls
from ..operators import catalog, lookups, rules, state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DAY = 86_400


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
LAST_TWO = r"regexp_replace({}, '^(.*\.)?([^.]*\.[^.]*)$', '\2')"
XOR = "list_aggregate(list_transform(range(1, length({0}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN chr(xor(ascii(substr({0}, i, 1)), 2)) ELSE substr({0}, i, 1) END), 'string_agg', '')"
ENCODE = "replace(replace(replace(replace(replace(url_encode({}), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*')"


@query(f"SELECT {LAST_TWO.format(HOST)} AS domain, count(*) AS n_pages, count(DISTINCT {HOST}) AS n_hosts FROM pages GROUP BY 1")
def url_host_domain(spark, sf_dir):
    h = urls.host(F.col("url"))
    return table(spark, sf_dir, "pages").select(h.alias("h")).groupBy(urls.registrable_domain(F.col("h")).alias("domain")).agg(F.count("*").alias("n_pages"), F.countDistinct("h").alias("n_hosts"))


@query(
    """SELECT page_id, regexp_extract(url, '^([a-z]+:)', 1) AS protocol, """
    + HOST
    + """ AS host,
    CASE WHEN url LIKE 'https:%' THEN '443' ELSE '80' END AS port,
    regexp_extract(url, '^[a-z]+://[^/]*([^#]*)', 1) AS path FROM pages"""
)
def url_envelope(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.envelope(F.col("url")).alias("e")).select("page_id", "e.*")


@query(
    """SELECT page_id, regexp_matches(t, '^https?://') OR contains(t, '.') AS is_url,
    CASE WHEN NOT (regexp_matches(t, '^https?://') OR contains(t, '.')) THEN 'https://search.example/?q=' || t WHEN regexp_matches(t, '^https?://') THEN t ELSE 'https://' || t END AS target,
    CASE WHEN starts_with(p, '/en/8') THEN 'dynamic' WHEN starts_with(p, '/en/') THEN 'static' ELSE 'passthrough' END AS route
    FROM (SELECT page_id, trim(CASE WHEN page_id % 2 = 0 THEN url ELSE replace(substr(url, 9), '.', ' ') END) AS t, regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1) AS p FROM pages)"""
)
def url_classify(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    t = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.replace(F.expr("substr(url, 9)"), F.lit("."), F.lit(" ")))
    path = F.regexp_extract("url", "^[a-z]+://[^/]*([^?#]*)", 1)
    return p.select("page_id", urls.is_url(t).alias("is_url"), urls.normalize(t, "https://search.example/?q=").alias("target"), urls.route_class(path, "/en/8", "/en/").alias("route"))


@query("SELECT page_id, " + ENCODE.format(XOR.format("url")) + " AS encoded, url AS decoded FROM pages")
def url_xor_encode(spark, sf_dir):
    e = table(spark, sf_dir, "pages").select("page_id", urls.xor_encode(F.col("url")).alias("encoded"))
    return e.select("page_id", "encoded", urls.xor_units(urls.uri_decode(F.col("encoded"))).alias("decoded"))


@query("SELECT page_id, md5(url) AS digest, regexp_replace(url, '/[^/]*$', '') AS folder, replace(to_base64(encode(url)), chr(10), '') AS b64 FROM pages")
def url_md5(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(u).alias("digest"), urls.strip_last_segment(u).alias("folder"), http.base64_latin1(u).alias("b64"))


@query("SELECT page_id, " + ENCODE.format("html") + " AS encoded FROM pages")
def html_uri_encode(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.uri_encode(F.col("html")).alias("encoded"))


@query(
    "SELECT page_id, 'https://site.example/a/q/' || " + ENCODE.format(XOR.format("page")) + " || rest AS address, url AS decoded FROM (SELECT page_id, url, regexp_extract(url, '^([^?#]*)', 1) AS page, regexp_extract(url, '^[^?#]*([?#].*)$', 1) AS rest FROM pages)"
)
def url_proxy_encode(spark, sf_dir):
    e = table(spark, sf_dir, "pages").select("page_id", urls.proxy_encode(F.col("url"), F.lit("https://site.example/"), "https://site.example", "/a/q/").alias("address"))
    return e.select("page_id", "address", urls.proxy_decode(F.col("address"), "/a/q/").alias("decoded"))


LINKS = "unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href"


@query(f"SELECT page_id, href, count(*) AS n FROM (SELECT page_id, {LINKS} FROM pages) GROUP BY ALL")
def link_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(html.attributes(F.col("html"), "href")).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query(
    f"""SELECT page_id, href, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^([a-z]+:)', 1) || href
    WHEN starts_with(href, '/') THEN origin || href WHEN starts_with(href, '?') THEN origin || path || href WHEN starts_with(href, '#') OR href = '' THEN regexp_replace(url, '#.*$', '') || href ELSE origin || regexp_replace(path, '[^/]*$', '') || href END AS target
    FROM (SELECT DISTINCT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, {LINKS} FROM pages)"""
)
def link_resolve(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(html.attributes(F.col("html"), "href")).alias("href")).distinct()
    return p.select("page_id", "href", urls.resolve(F.col("url"), F.col("href")).alias("target"))


@query(
    """SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<!doctype') THEN 0 ELSE 1 END AS added, length(html) + length('<base>') + CASE WHEN regexp_matches(html, '(?i)<!doctype') THEN 0 ELSE 15 END AS n_chars,
    CASE WHEN regexp_matches(substr(html, 1, 100), '(?i)<(!doctype html|html|head|script)') THEN 'html' ELSE 'other' END AS kind FROM pages"""
)
def html_rewrite(spark, sf_dir):
    h = F.col("html")
    out = html.inject_head(html.with_doctype(h), "<base>")
    return table(spark, sf_dir, "pages").select("page_id", (~h.rlike("(?i)<!doctype")).cast("int").alias("added"), F.length(out).cast("long").alias("n_chars"), http.content_kind(F.lit(None).cast("string"), F.lit(""), h).alias("kind"))


@query("SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'heti')")
def doc_search(spark, sf_dir):
    return catalog.name_contains(table(spark, sf_dir, "documents"), "HETI", "text").select("doc_id", "n_chars")


@query("SELECT doc_id, greatest(CAST(ceil(length(text) / 3072.0) AS BIGINT), 1) AS n_chunks, md5(text) AS rejoined, md5(substr(text, 1, 3072)) AS first_chunk FROM documents WHERE text IS NOT NULL")
def header_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", http.chunks(F.col("text")).alias("c"))
    return d.select("doc_id", F.size("c").cast("long").alias("n_chunks"), F.md5(http.rejoin(F.reverse("c"))).alias("rejoined"), F.md5(F.get("c", 0)["part"]).alias("first_chunk"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'click')")
def event_category_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("categories", F.array(F.lit("all"), "event_type"))
    return catalog.in_categories(e, ["view", "click"]).select("event_id", "event_type")


@query("SELECT user_id AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'")
def kv_last_write(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("value"))
    return lookups.last_write(log)


@query(
    """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
    s AS (SELECT user_id, i, t AS at, 0::BIGINT AS hits, 1::BIGINT AS misses FROM e WHERE i = 1
      UNION ALL SELECT e.user_id, e.i, CASE WHEN e.t - s.at <= 86400000000 THEN s.at ELSE e.t END, s.hits + CASE WHEN e.t - s.at <= 86400000000 THEN 1 ELSE 0 END, s.misses + CASE WHEN e.t - s.at <= 86400000000 THEN 0 ELSE 1 END
      FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
    SELECT user_id, CAST(max(hits) AS BIGINT) AS hits, CAST(max(misses) AS BIGINT) AS misses FROM s GROUP BY user_id"""
)
def ttl_cache_hits(spark, sf_dir):
    return state.ttl_cache(table(spark, sf_dir, "events"), "user_id", "ts", DAY)


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_type AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    s AS (SELECT user_id, i, v = 'view' AS half, 0::BIGINT AS n FROM e WHERE i = 1
      UNION ALL SELECT e.user_id, e.i, e.v = 'view' AND NOT s.half, s.n + CASE WHEN e.v = 'view' AND s.half THEN 1 ELSE 0 END
      FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
    SELECT user_id, CAST(max(n) AS BIGINT) AS matches FROM s GROUP BY user_id"""
)
def seq_nonoverlap(spark, sf_dir):
    return state.sequence_matches(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", ["view", "view"])


@query(
    "SELECT user_id, list(event_id ORDER BY ts, event_id)[-5:] AS last_events FROM events GROUP BY user_id"
)
def last_n_buffer(spark, sf_dir):
    return state.last_n(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_id", 5).withColumnRenamed("last", "last_events")


@query("SELECT n_name, (row_number() OVER (ORDER BY n_name) - 1)::INTEGER AS ordinal FROM nation")
def catalog_order(spark, sf_dir):
    return catalog.ordered(table(spark, sf_dir, "nation"), "n_name").select("n_name", "ordinal")


@query(
    """WITH o AS (SELECT n_name, (row_number() OVER (ORDER BY n_name) - 1)::INTEGER AS ordinal FROM nation)
    SELECT n_name, ordinal, ordinal IN (3, 7) AS is_pinned, (row_number() OVER (ORDER BY CASE WHEN ordinal IN (3, 7) THEN 0 ELSE 1 END, ordinal) - 1)::INTEGER AS position FROM o"""
)
def pin_partition(spark, sf_dir):
    c = catalog.ordered(table(spark, sf_dir, "nation"), "n_name").select("n_name", "ordinal")
    pins = spark.range(1).select(F.explode(catalog.parse_pins(F.lit("0,7,3,x,7"))).alias("pin"))
    return catalog.pinned(c, pins).select("n_name", "ordinal", "is_pinned", "position")


@query("SELECT c_custkey, n_name, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'work' ELSE 'other' END AS setting FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def dictionary_lookup(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return lookups.lookup(c, n, "c_nationkey").select("c_custkey", "n_name", lookups.mapped(F.col("c_mktsegment"), {"BUILDING": "work", "MACHINERY": "work"}, "other").alias("setting"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://m.') THEN 'mobile' WHEN starts_with(url, 'https://') THEN 'secure' WHEN starts_with(url, 'http://') THEN 'plain' END AS base FROM pages")
def prefix_lookup(spark, sf_dir):
    return lookups.by_prefix(table(spark, sf_dir, "pages"), "url", {"https://m.": "mobile", "https://": "secure", "http://": "plain"}, "base").select("page_id", "base")


@query(f"SELECT page_id, CASE WHEN h = 'ththre.example.com' OR regexp_matches(h, '^blog[.]') OR regexp_matches(h, 'net$') THEN 403 ELSE 200 END AS status, ends_with(h, 'example.com') AS in_parent FROM (SELECT page_id, {HOST} AS h FROM pages)")
def host_blocklist(spark, sf_dir):
    h = urls.host(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.when(lookups.blocked(h, ["ththre.example.com"], ["^blog[.]", "net$"]), 403).otherwise(200).alias("status"), urls.in_parent_domain(h, F.lit("www.example.com")).alias("in_parent"))


@query(
    f"""WITH c AS (SELECT DISTINCT {HOST} AS host, 'lang' AS name, regexp_extract(url, '^[a-z]+://[^/]*/([a-z]*)', 1) AS value FROM pages UNION SELECT DISTINCT {LAST_TWO.format(HOST)}, 'site', 'all' FROM pages),
    up AS (SELECT h.host, c.name, c.value FROM (SELECT DISTINCT host, {LAST_TWO.format('host')} AS p FROM c) h JOIN c ON c.host = h.p WHERE h.host <> h.p)
    SELECT host, string_agg(name || '=' || value, '; ' ORDER BY name, value) AS cookie FROM (SELECT * FROM c UNION SELECT * FROM up) GROUP BY host"""
)
def cookie_parent_merge(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/]*/([a-z]*)", 1).alias("value"))
    own = p.select("host", F.lit("lang").alias("name"), "value").unionByName(p.select(urls.registrable_domain(F.col("host")).alias("host"), F.lit("site").alias("name"), F.lit("all").alias("value"))).distinct()
    merged = lookups.with_parent_cookies(own, urls.registrable_domain(F.col("host")))
    return merged.groupBy("host").agg(http.cookie_header(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("cookie"))


@query("SELECT user_id AS session, list(DISTINCT event_type ORDER BY event_type) AS names, count(*) FILTER (WHERE starts_with(event_type, 'c')) AS in_namespace, bool_and(value >= 0) AS every, bool_or(value > 100) AS some FROM events GROUP BY 1")
def group_folds(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session")).agg(F.array_sort(F.collect_set("event_type")).alias("names"), F.count(F.when(F.col("event_type").startswith("c"), 1)).alias("in_namespace"), F.every(F.col("value") >= 0).alias("every"), F.some(F.col("value") > 100).alias("some"))
    return e


@query("SELECT event_id, CAST((event_id + 1) % 13 AS BIGINT) AS next, CASE WHEN event_type = 'error' THEN 'red' WHEN event_type IN ('click', 'view') THEN 'yellow' END AS level, CASE WHEN event_type = 'error' THEN 'Broken' WHEN event_type = 'click' THEN 'Loads' WHEN event_type = 'view' THEN 'Works in part' END AS say FROM events")
def status_severity(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    flags = e.select("event_id", *[F.when(F.col("event_type") == v, "true").alias(k) for k, v in (("error", "error"), ("load", "click"), ("partial", "view"))], F.lit("").alias("say"))
    level, say = catalog.severity({"error": "Broken", "load": "Loads", "partial": "Works in part"})
    return flags.select("event_id", lookups.next_index(F.col("event_id"), 13).alias("next"), level.alias("level"), say.alias("say"))


@query(
    """SELECT page_id, element, attribute, 'encode' AS action, count(*) AS n FROM (
    SELECT page_id, 'a' AS element, 'href' AS attribute, unnest(regexp_extract_all(html, '(?i)<(a\\b[^>]*)>', 1)) AS tag FROM pages
    UNION ALL SELECT page_id, 'img', 'src', unnest(regexp_extract_all(html, '(?i)<(img\\b[^>]*)>', 1)) FROM pages)
    WHERE regexp_matches(tag, '\\s' || attribute || '="') GROUP BY ALL"""
)
def attribute_rules(spark, sf_dir):
    rows = rules.attribute_rows(table(spark, sf_dir, "pages"), ["a", "img"], ["href", "src"])
    table_of_rules = spark.range(1).select(F.lit("encode").alias("action"), F.explode(F.array(F.struct(F.array(F.lit("a")).alias("e"), F.array(F.lit("href")).alias("a")), F.struct(F.array(F.lit("img")).alias("e"), F.array(F.lit("src")).alias("a")))).alias("r")).select("action", F.col("r.e").alias("elements"), F.col("r.a").alias("attributes"))
    return rules.matched_rules(rows, table_of_rules).groupBy("page_id", "element", "attribute", "action").agg(F.count("*").alias("n"))


from . import web  # noqa: E402, F401  registers its queries here
