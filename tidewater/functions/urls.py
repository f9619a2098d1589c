"""URLs as column expressions: parts, classification, normalization, codecs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Lower-case host of an absolute URL; null otherwise."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def registrable_domain(h: Column) -> Column:
    """The behaviour fixes this rule: the last two labels of a host; a host without a dot is unchanged."""
    return F.regexp_replace(h, r"^(.*\.)?([^.]*\.[^.]*)$", "$2")


def in_parent_domain(value: Column, h: Column) -> Column:
    """Whether value ends with the last two labels of h."""
    return F.endswith(value, F.substring_index(h, ".", -2))


def is_url(text: Column) -> Column:
    """`http(s)://` first, or a dot somewhere and no space at the start."""
    t = F.trim(text)
    return t.rlike("^https?://") | (t.contains(".") & ~t.startswith(" "))


def normalize(text: Column, search_prefix: str) -> Column:
    """What a typed text leads to: a search, or a URL with a scheme."""
    t = F.trim(text)
    return F.when(~is_url(t), F.concat(F.lit(search_prefix), t)).when(t.rlike("^https?://"), t).otherwise(F.concat(F.lit("https://"), t))


def route_class(path: Column, inner: str, outer: str) -> Column:
    """`dynamic` under the inner prefix, `static` under the outer one, else `passthrough`; the first match wins."""
    return F.when(path.startswith(inner), "dynamic").when(path.startswith(outer), "static").otherwise("passthrough")


def envelope(url: Column) -> Column:
    """protocol, host, port (by scheme where none is given) and path with query of a URL."""
    protocol = F.concat(F.parse_url(url, F.lit("PROTOCOL")), F.lit(":"))
    port = F.nullif(F.regexp_extract(url, r"^[a-z]+://[^/?#]*?:(\d+)", 1), F.lit(""))
    rest = F.concat(F.coalesce(F.nullif(F.parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/")), F.coalesce(F.concat(F.lit("?"), F.parse_url(url, F.lit("QUERY"))), F.lit("")))
    return F.struct(protocol.alias("protocol"), host(url).alias("host"), F.coalesce(port, F.when(protocol == "https:", "443").otherwise("80")).alias("port"), rest.alias("path"))


def redirect_target(method: Column, url: Column, form: Column) -> Column:
    """status and target of a redirect request: 405 for other methods than GET and POST, 400 without `url`."""
    query = F.parse_url(url, F.lit("QUERY"), F.lit("url"))
    target = F.try_url_decode(F.when(method == "POST", F.coalesce(form, query)).otherwise(query))
    status = F.when(~method.isin("GET", "POST"), 405).when(target.isNull() | (target == ""), 400).otherwise(301)
    return F.struct(status.alias("status"), F.when(status == 301, target).alias("target"))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row; a Column used several times is computed, and planned, as often."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), 0)


def strip_last_segment(url: Column) -> Column:
    return F.regexp_replace(url, "/[^/]*$", "")


def replace_first(text: Column, old: str, new: Column) -> Column:
    """Only the first occurrence of a plain string."""
    at = F.instr(text, old)
    return F.when(at == 0, text).otherwise(F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + len(old), F.length(text))))


def uri_encode(text: Column) -> Column:
    """Percent-encoding of all but letters, digits and - _ . ! ~ * ' ( )."""
    c = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        c = F.replace(c, F.lit(code), F.lit(char))
    return c


def uri_decode(text: Column) -> Column:
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def xor_units(text: Column, key: int = 2) -> Column:
    """Every second UTF-16 unit (the second first) with the bits of key flipped; its own inverse."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(....)"), F.lit(1))
    flipped = F.transform(units, lambda u, i: F.when(i % 2 == 1, F.lpad(F.hex(F.conv(u, 16, 10).cast("long").bitwiseXOR(F.lit(key))), 4, "0")).otherwise(u))
    return F.when(text == "", text).otherwise(F.decode(F.unhex(F.array_join(flipped, "")), "UTF-16BE"))


def xor_encode(text: Column, key: int = 2) -> Column:
    return uri_encode(xor_units(text, key))


def xor_decode(text: Column, key: int = 2) -> Column:
    """The part before the first `?` decoded, the rest as it is."""
    head = F.substring_index(text, "?", 1)
    return F.concat(xor_units(uri_decode(head), key), F.substring(text, F.length(head) + 1, F.length(text)))


def resolve(base: Column, ref: Column) -> Column:
    """An absolute URL from a reference: absolute, `//host`, `/path`, `?query`, `#hash` or a relative path; `./` and `../` collapse."""
    origin = F.regexp_extract(base, r"^([a-z]+://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    full = (
        F.when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), ref).when(ref.startswith("//"), F.concat(F.regexp_extract(base, "^([a-z]+:)", 1), ref)).when(ref.startswith("/"), F.concat(origin, ref))
        .when(ref.startswith("?"), F.concat(origin, path, ref)).when(ref.startswith("#") | (ref == ""), F.concat(F.regexp_replace(base, "#.*$", ""), ref)).otherwise(F.concat(origin, F.regexp_replace(path, "[^/]*$", ""), ref))
    )
    def collapsed(u):
        parts = F.split(F.regexp_extract(u, r"^[a-z]+://[^/?#]*(/[^?#]*)", 1), "/")
        kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.when(F.size(a) > 1, F.slice(a, 1, F.size(a) - 1)).otherwise(a)).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
        rooted = let(F.array_join(kept, "/"), lambda p: F.when(p.startswith("/") | (p == ""), p).otherwise(F.concat(F.lit("/"), p)))
        return F.concat(F.regexp_extract(u, r"^([a-z]+://[^/?#]*)", 1), rooted, F.regexp_extract(u, r"^[a-z]+://[^?#]*([?#].*)$", 1))
    return let(full, lambda u: F.when(u.rlike(r"/\.{1,2}(/|$|[?#])"), collapsed(u)).otherwise(u))


def proxy_encode(url: Column, base: Column, origin: str, prefix: str, wrapper: str = "run") -> Column:
    """A URL as the address behind a prefix: the page part encoded, query and hash after it. By the first rule:
    empty URLs and chrome-extension: are unchanged, about:blank gets the prefix before it, javascript: has its text put into wrapper(...);
    what stands before an embedded http(s) URL goes; those already behind the prefix, #, about:, mailto:, blob:, data:
    are unchanged."""
    def page_and_rest(u):
        page, rest = F.regexp_extract(u, r"^([^?#]*)", 1), F.regexp_extract(u, r"^[^?#]*([?#].*)$", 1)
        return F.concat(F.lit(origin + prefix), xor_encode(page), rest)
    def address(inner):
        there = inner.startswith(origin + prefix) | inner.startswith(prefix) | inner.rlike("^(#|about:|mailto:|blob:|data:)")
        return F.when(there, inner).otherwise(let(resolve(base, inner), page_and_rest))
    def ladder(u):
        script = F.substring(F.to_json(F.array(F.substring(u, 12, 1 << 30))), 2, 1 << 30)
        return (
            F.when(u.isNull() | (u == ""), u).when(u.startswith("about:blank"), F.concat(F.lit(origin + prefix), u)).when(u.startswith("chrome-extension://"), u)
            .when(u.startswith("javascript:"), F.concat(F.lit(f"javascript:{wrapper}("), F.regexp_replace(script, r"\]$", ")")))
            .otherwise(let(F.coalesce(F.nullif(F.regexp_extract(u, r"^[/A-Za-z0-9\-%]+(https?://.*)", 1), F.lit("")), u), address))
        )
    return let(url, ladder)


def rebase(url: Column, own: str, base: Column, encode) -> Column:
    """The URL of a request that a page at base made, whose own origin stands for that of base, encoded; what isn't http(s) stays."""
    path = F.when(url.startswith(own), F.substring(url, len(own) + 1, 1 << 30)).otherwise(url)
    return F.when(~url.startswith("http"), url).otherwise(encode(resolve(base, path)))


def under(url: Column, own: str, prefix: str) -> Column:
    """Whether the path of a URL of this origin begins with a prefix."""
    return url.startswith(own) & F.substring(url, len(own) + 1, len(prefix)).eqNullSafe(prefix)


def allowed_host(h: Column, hosts: list[str]) -> Column:
    return ~h.isin(hosts)


def transport_route(path: Column, prefix: str) -> Column:
    """Who answers a request: the transport, or the app."""
    return F.when(path.startswith(prefix), "transport").otherwise("app")


def characters(text: Column) -> Column:
    """The UTF-16 units of a text, as hexadecimal digits."""
    return F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(....)"), F.lit(1))


def proxy_decode(url: Column, prefix: str) -> Column:
    def decoded(tail):
        page, rest = F.regexp_extract(tail, r"^([^?#]*)", 1), F.regexp_extract(tail, r"^[^?#]*([?#].*)$", 1)
        return F.concat(let(uri_decode(page), xor_units), rest)
    at = F.instr(url, prefix)
    return F.when(at == 0, url).otherwise(let(F.substring(url, at + len(prefix), F.length(url)), decoded))
