"""Headers, cookies, media types and payload codecs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_wins(entries: Column) -> Column:
    """A map of (key, value) structs; of a key that repeats the last counts."""
    return F.map_from_entries(F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"])))


def lower_keys(headers: Column) -> Column:
    """Lower-case names; of names that become equal the last counts."""
    return last_wins(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))


def request_headers(headers: Column, target: Column, page: Column, cookie: Column, agent: Column, mode: Column, dest: Column, page_only_origin: bool = False) -> Column:
    """Headers of a request to target (a URL) from a page (a URL, or null): Origin, Host and Referer anew, Cookie and
    user agent where there are any, and the fetch metadata."""
    def origin(u):
        return F.regexp_extract(u, r"^([a-z]+://[^/?#]*)", 1)
    h = F.map_filter(headers, lambda k, v: ~F.lower(k).isin("origin", "host", "referer") & ~((F.lower(k) == "user-agent") & agent.isNotNull()))
    site = F.when(mode == "navigate", "same-origin").when(page.isNull(), "none").when(origin(page) == origin(target), "same-origin").otherwise("cross-site")
    referer = F.coalesce(origin(page) if page_only_origin else page, F.concat(origin(target), F.lit("/")) if page_only_origin else target)
    new = [("Origin", F.coalesce(origin(page), origin(target))), ("Host", F.regexp_extract(target, r"^[a-z]+://([^/?#]*)", 1)), ("Referer", referer), ("Cookie", F.nullif(cookie, F.lit(""))), ("user-agent", agent), ("sec-fetch-dest", F.coalesce(dest, F.lit("empty"))), ("sec-fetch-mode", F.coalesce(mode, F.lit("cors"))), ("sec-fetch-site", site), ("sec-fetch-user", F.lit("?1"))]
    added = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in new]), lambda e: e["value"].isNotNull())
    return last_wins(F.concat(F.map_entries(h), added))


def response_headers(headers: Column, drop: list[str], encode) -> Column:
    """Without the names of drop and without cookies to set; the target of a redirect encoded."""
    kept = F.map_filter(headers, lambda k, v: ~F.lower(k).isin([*drop, "set-cookie"]))
    return F.transform_values(kept, lambda k, v: F.when(F.lower(k) == "location", encode(v)).otherwise(v))


def drop_headers(headers: Column, names: list[str]) -> Column:
    """Without the headers of these lower-case names."""
    return F.map_filter(headers, lambda k, v: ~F.lower(k).isin(names))


def with_headers(headers: Column, **values: Column) -> Column:
    """Headers replaced by values that are not null; `_` in a name stands for `-`."""
    names = [k.replace("_", "-") for k in values]
    added = F.map_filter(F.create_map(*[x for k, v in zip(names, values.values()) for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    return F.map_concat(F.map_filter(headers, lambda k, v: ~F.array_contains(F.map_keys(added), F.lower(k))), added)


def rewrite_header(headers: Column, name: str, rewrite) -> Column:
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k) == name, rewrite(v)).otherwise(v))


def is_token(name: Column) -> Column:
    """Whether all characters may stand in a header's name."""
    return name.rlike(r"^[!#$%&'*+.^_`|~0-9A-Za-z-]+\z")


#: Statuses without a body: of any response, and the fewer that the second rewriter knows.
EMPTY, EMPTY_FEW = (101, 204, 205, 304), (204, 304)


def has_body(method: Column, status: Column, empty: tuple[int, ...] = EMPTY) -> Column:
    return ~method.isin("GET", "HEAD") & ~status.isin(*empty)


def chunks(value: Column, size: int = 3072) -> Column:
    """[(ordinal, part)] of at most size characters, by one pass; one empty part for an empty value."""
    parts = F.regexp_extract_all(value, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.transform(F.when(value == "", F.array(F.lit(""))).otherwise(parts), lambda p, i: F.struct(i.alias("ordinal"), p.alias("part")))


def rejoin(parts: Column) -> Column:
    """The value of parts in any order."""
    return F.array_join(F.transform(F.array_sort(parts), lambda p: p["part"]), "")


def cookie_pairs(header: Column) -> Column:
    """[(name, value)] of a Cookie header; quotes around a value go, percent codes are decoded."""
    parts = F.filter(F.transform(F.split(header, ";"), lambda p: F.trim(p)), lambda p: F.instr(p, "=") > 1)
    def pair(p):
        value = F.trim(F.substring(p, F.instr(p, "=") + 1, F.length(p)))
        bare = F.regexp_replace(value, '^"(.*)"$', "$1")
        return F.struct(F.trim(F.substring_index(p, "=", 1)).alias("name"), F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare).alias("value"))
    return F.transform(parts, pair)


def cookies(header: Column) -> Column:
    """name -> value; of a name that repeats the first counts."""
    pairs = cookie_pairs(header)
    firsts = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["name"]), p["name"]) == i + 1)
    return F.map_from_entries(firsts)


def naive_cookies(header: Column) -> Column:
    """[(name, value)], the value cut at a second `=`."""
    return F.transform(F.filter(F.split(header, ";"), lambda p: p != ""), lambda p: F.struct(F.trim(F.get(F.split(p, "="), 0)).alias("name"), F.get(F.split(p, "="), 1).alias("value")))


def split_set_cookie(header: Column) -> Column:
    """The cookies of a combined header: cut at commas that a name and `=` follow."""
    return F.transform(F.split(header, r",(?=\s*[^=;,\s]+=)"), lambda x: F.trim(x))


def set_cookie(text: Column) -> Column:
    """name, value and a map of lower-case attributes (flags: empty; of one that repeats the last counts)."""
    parts = F.transform(F.split(text, ";"), lambda p: F.trim(p))
    first = F.get(parts, 0)
    rest = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p != "")
    attributes = last_wins(F.transform(rest, lambda p: F.struct(F.lower(F.substring_index(p, "=", 1)).alias("key"), F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise("").alias("value"))))
    return F.struct(F.substring_index(first, "=", 1).alias("name"), F.substring(first, F.instr(first, "=") + 1, F.length(first)).alias("value"), attributes.alias("attributes"))


def serialize_cookie(name: Column, value: Column, path: Column, expires: Column, secure: Column, domain: Column | None = None, max_age: Column | None = None, http_only: Column | None = None, same_site: Column | None = None) -> Column:
    """A Set-Cookie header without what is null; null for a name that isn't a token, or a value, path or
    domain with a character that may not stand in a header, or an unknown SameSite."""
    none = F.lit(None).cast("string")
    domain, max_age, same_site, http_only = (none if c is None else c for c in (domain, max_age, same_site, http_only))
    def fits(c):
        return F.coalesce(c.rlike(r"^[\t\x20-\x7e\x80-\xff]*\z"), F.lit(True))
    site = F.lower(same_site)
    sound = is_token(name) & value.isNotNull() & fits(value) & fits(path) & fits(domain) & F.coalesce(site.isin("strict", "lax", "none"), F.lit(True))
    parts = [F.concat(name, F.lit("="), value), F.concat(F.lit("Max-Age="), F.floor(max_age.cast("double")).cast("string")), F.concat(F.lit("Domain="), domain), F.concat(F.lit("Path="), path), F.concat(F.lit("Expires="), expires), F.when(http_only.cast("boolean"), "HttpOnly"), F.when(secure, "Secure"), F.concat(F.lit("SameSite="), F.initcap(site))]
    return F.when(sound, F.concat_ws("; ", *parts))


def cookie_header(jar: Column) -> Column:
    """`a=1; b=2` of an array of (name, value)."""
    return F.array_join(F.transform(jar, lambda c: F.concat(c["name"], F.lit("="), c["value"])), "; ")


def extension(path: Column) -> Column:
    """Lower-case extension of a path's last segment; null without one."""
    return F.nullif(F.lower(F.regexp_extract(F.regexp_replace(path, "[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1)), F.lit(""))


def content_kind(mime: Column, path: Column, body: Column) -> Column:
    """html, js, css or other: by type, else by extension, else by a tag in the first 100 characters."""
    ext, start = extension(path), F.substring(body, 1, 100)
    by_type = F.when(mime.rlike("(?i)html"), "html").when(mime.rlike("(?i)javascript|ecmascript"), "js").when(mime.rlike("(?i)css"), "css")
    by_name = F.when(ext.isin("html", "htm"), "html").when(ext.isin("js", "mjs"), "js").when(ext == "css", "css")
    return F.coalesce(by_type, by_name, F.when(start.rlike("(?i)<(!doctype html|html|head|script)"), "html"), F.lit("other"))


def base64_latin1(text: Column) -> Column:
    """Base64 of Latin-1 text; null where a character is beyond."""
    return F.when(text.rlike("^[\\x00-\\xff]*$"), F.regexp_replace(F.base64(F.encode(text, "ISO-8859-1")), "\\s", ""))


def base64_text(b64: Column) -> Column:
    """The Latin-1 text of a base64; null for what isn't one."""
    return F.decode(F.try_to_binary(b64, F.lit("base64")), "ISO-8859-1")


def base64_lines(b64: Column, width: int = 64) -> Column:
    return F.regexp_replace(b64, "(.{%d})(?=.)" % width, "$1\n")


def openssl_key_iv(password: Column, salt: Column) -> tuple[Column, Column]:
    """32 bytes of key and 16 of vector, from a chain of MD5 digests."""
    seed = F.concat(F.encode(password, "UTF-8"), salt)
    d1 = F.unhex(F.md5(seed))
    d2 = F.unhex(F.md5(F.concat(d1, seed)))
    d3 = F.unhex(F.md5(F.concat(d2, seed)))
    return F.concat(d1, d2), d3


def aes_encrypt(text: Column, password: Column, salt: Column) -> Column:
    """Base64 of `Salted__`, the salt and AES-256-CBC, as OpenSSL writes it."""
    key, iv = openssl_key_iv(password, salt)
    body = F.aes_encrypt(F.encode(text, "UTF-8"), key, F.lit("CBC"), F.lit("PKCS"), iv)
    return F.regexp_replace(F.base64(F.concat(F.encode(F.lit("Salted__"), "UTF-8"), salt, F.substring(body, F.lit(17), F.length(body)))), "\\s", "")


def aes_decrypt(b64: Column, password: Column) -> Column:
    data = F.unbase64(b64)
    salt = F.substring(data, 9, 8)
    key, iv = openssl_key_iv(password, salt)
    return F.decode(F.aes_decrypt(F.concat(iv, F.substring(data, F.lit(17), F.length(data))), key, F.lit("CBC"), F.lit("PKCS")), "UTF-8")
