"""HTML, CSS and manifest text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def attributes(html: Column, name: str) -> Column:
    """All values of an attribute in tags, in order: in either kind of quotes or bare, the name in any case."""
    tags = F.regexp_extract_all(html, F.lit(r"<[A-Za-z][^>]*>"), F.lit(0))
    pattern = rf"(?i)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
    return F.transform(F.flatten(F.transform(tags, lambda t: F.regexp_extract_all(t, F.lit(pattern), F.lit(1)))), _bare)


def _bare(value: Column) -> Column:
    return F.regexp_replace(value, r"^[\"']|[\"']$", "")


def _joined(heads: Column, values: Column, encode):
    def put(t, i):
        v = F.get(values, i)
        quote = F.regexp_extract(v, r"^([\"'])", 1)
        return F.concat(t, F.when(i < F.size(values), F.concat(F.get(heads, i), quote, encode(_bare(v)), quote)).otherwise(""))
    return put


def rewrite_attributes(html: Column, rules: list[tuple[list[str], list[str]]], encode) -> Column:
    """html with the values of the rules' attributes (of any of the rule's elements) encoded; quotes and all else as they are."""
    for elements, names in rules:
        for name in names:
            pattern = rf"(?is)(<(?:{'|'.join(elements)})\b[^>]*?\s{name}\s*=\s*)(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
            heads, values = (F.regexp_extract_all(html, F.lit(pattern), F.lit(k)) for k in (1, 2))
            html = F.array_join(F.transform(F.split(html, pattern, -1), _joined(heads, values, encode)), "")
    return html


def rewrite_srcset(srcset: Column, encode) -> Column:
    """The first token of each candidate encoded."""
    return F.array_join(F.transform(F.split(srcset, ", "), lambda c: F.concat(encode(F.substring_index(c, " ", 1)), F.substring(c, F.length(F.substring_index(c, " ", 1)) + 1, F.length(c)))), ", ")


def rewrite_css(css: Column, encode) -> Column:
    """Each url(...) with its address encoded; the surroundings as they are."""
    pattern = r"url\(['\"]?([^'\")]*)['\"]?\)"
    between, urls = F.split(css, pattern), F.regexp_extract_all(css, F.lit(pattern), F.lit(1))
    return F.array_join(F.transform(between, lambda t, i: F.concat(t, F.when(i < F.size(urls), F.concat(F.lit("url("), encode(F.coalesce(F.get(urls, i), F.lit(""))), F.lit(")"))).otherwise(""))), "")


def with_doctype(html: Column) -> Column:
    return F.when(html.rlike("(?i)<!doctype"), html).otherwise(F.concat(F.lit("<!DOCTYPE html>"), html))


def inject_head(html: Column, head: str) -> Column:
    """Text after the first doctype or <html> tag."""
    return F.regexp_replace(html, r"(?is)^(.*?(?:<!doctype[^>]*>|<html[^>]*>))(.*)$", "$1" + head.replace("$", "\\$") + "$2")


def rename_attribute(html: Column, old: str, new: str) -> Column:
    """Of script and link tags; the first in each tag."""
    return F.regexp_replace(html, rf"(?i)(<(?:script|link)\b[^>]*?\s){old}=", "$1" + new + "=")


def redirect_page(url: Column) -> Column:
    return F.when(url.isNotNull(), F.format_string('<!DOCTYPE html><meta http-equiv="refresh" content="0;url=%s">', url))


def rewrite_manifest(manifest: Column, encode, suffix: str) -> Column:
    """icons[].src, shortcuts[].url, start_url and scope encoded, suffix after the names, serviceworker gone;
    all other fields stay. Null for what isn't an object."""
    record, records = "map<string,variant>", "array<map<string,variant>>"
    m = F.from_json(manifest, record)
    def text(v):
        return F.try_variant_get(v, "$", "string")
    def put(old, key, value):
        return F.map_concat(F.map_filter(old, lambda k, _: k != key), F.when(value.isNotNull(), F.map_from_arrays(F.array(F.lit(key)), F.array(value.cast("variant")))).otherwise(F.from_json(F.lit("{}"), record)))
    def each(key, field):
        return F.to_variant_object(F.transform(F.try_variant_get(m[key], "$", records), lambda x: put(x, field, encode(text(x[field])))))
    out = F.map_filter(m, lambda k, _: k != "serviceworker")
    for key in ("name", "short_name"):
        out = put(out, key, F.concat(text(m[key]), F.lit(suffix)))
    for key in ("start_url", "scope"):
        out = put(out, key, encode(text(m[key])))
    for key, field in (("icons", "src"), ("shortcuts", "url")):
        out = put(out, key, each(key, field))
    return F.to_json(out)
