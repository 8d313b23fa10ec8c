"""Scalar functions: redaction, safe names, URLs, coercion, ids and page reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions import lexicons as L

LOCAL_PATH = r'(?i)\b(?:[a-z]:\\|\\\\[^\\\s]+\\|/users/|/home/|/var/|/tmp/)[^\s<>"]+'
PRIVATE_PATH = r"(?i)([A-Za-z]:\\Users\\|/Users/|/home/|\\\\[^\\\s]+\\[^\\\s]+)"
SECRET = r"(?i)(api[_-]?key|secret|token|password)\s*[:=]\s*[A-Za-z0-9_\-]{8,}"
LINK = r"https?://[^\s)>\]\"']+"
FACT = r"\d+(?:[.,]\d+)*%?"


def is_sensitive(key: Column) -> Column:
    low = F.replace(F.lower(key), F.lit("-"), F.lit("_"))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in L.SENSITIVE_KEYS])


def redact_url(url: Column) -> Column:
    """Without query, fragment and user; cut to the longest string where it is no URL."""
    host = F.regexp_replace(F.parse_url(url, F.lit("AUTHORITY")), "^.*@", "")
    clean = F.concat(F.parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.lower(host), F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")))
    return F.coalesce(clean, F.substring(url, 1, L.MAX_STRING))


def redact_map(values: Column) -> Column:
    """Flat string map: values of sensitive keys are replaced, URLs cleaned, long strings cut."""
    cut = lambda v: F.when(F.length(v) > L.MAX_STRING, F.concat(F.substring(v, 1, L.MAX_STRING), F.lit("..."))).otherwise(v)
    return F.transform_values(values, lambda k, v: F.when(is_sensitive(k), F.lit("[REDACTED]")).when(F.contains(F.lower(k), F.lit("url")), redact_url(v)).otherwise(cut(v)))


def mask_config(values: Column) -> Column:
    """Flat string map with values of key-like names masked."""
    words = ("key", "secret", "token", "password", "credential")
    return F.transform_values(values, lambda k, v: F.when(reduce(lambda a, b: a | b, [F.contains(F.lower(k), F.lit(w)) for w in words]), F.lit("****")).otherwise(v))


def redact_paths(text: Column) -> Column:
    return F.regexp_replace(text, LOCAL_PATH, "[redacted-path]")


def links(text: Column) -> Column:
    """Distinct plain URLs without trailing dots and commas, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(LINK), 0), lambda u: F.regexp_replace(u, "[.,]+$", ""))))


def facts(text: Column) -> Column:
    """Distinct numbers of a text without their percent signs, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(FACT), 0), lambda u: F.regexp_replace(u, "%+$", ""))))


def safe_stem(name: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(out == "", "document").otherwise(F.substring(out, 1, 120))


def safe_leaf(path: Column) -> Column:
    return safe_stem(F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1))


def attachment_name(raw: Column, index: Column) -> Column:
    leaf = F.element_at(F.split(F.replace(raw, F.lit("\\"), F.lit("/")), "/"), -1)
    clean = F.regexp_replace(F.regexp_replace(F.trim(leaf), r"^\.+|\.+$", ""), r'[\x00-\x1f<>:"|?*]', "_")
    named = F.when(clean == "", F.concat(F.lit("attachment_"), index.cast("string"))).otherwise(clean)
    return F.when(F.length(named) > 120, F.concat(F.substring(named, 1, 117), F.lit("..."))).otherwise(named)


def relative_path(path: Column) -> Column:
    """Parts without empty ones, dots and parent references."""
    return F.array_join(F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", ".", "..")), "/")


def compression_ratio(size: Column, packed: Column) -> Column:
    return F.when(size == 0, 0.0).when(packed == 0, float("inf")).otherwise(size / packed)


def url_verdict(url: Column, allowed: tuple[str, ...]) -> Column:
    """Scheme, credentials and host of a URL; private and loopback addresses are blocked. Names are not resolved."""
    scheme, host = F.lower(F.parse_url(url, F.lit("PROTOCOL"))), F.lower(F.parse_url(url, F.lit("HOST")))
    private = host.rlike(r"^(127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|0\.|localhost$)")
    fits = reduce(lambda a, b: a | b, [(host == h) | F.endswith(host, F.lit("." + h)) for h in allowed])
    return F.when(~F.coalesce(scheme.isin("http", "https"), F.lit(False)), "bad_scheme").when(F.parse_url(url, F.lit("USERINFO")).isNotNull(), "credentials").when(host.isNull(), "no_host").when(private, "blocked_address").when(~fits, "host_not_allowed").otherwise("ok")


def coerce_kind(text: Column) -> Column:
    """What a string stands for: true, false, null, int, float or string."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "false"), "bool").when(low.isin("null", "none"), "null").when(text.rlike(r"^[+-]?\d+$"), "int").when(text.rlike(r"^[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?$"), "float").otherwise("string")


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes", "on"), F.lit(False))


def range_count(spec: Column) -> Column:
    """Pages named by a spec like 1-3,5; -1 where it is malformed."""
    parts = F.split(F.regexp_replace(spec, r"\s", ""), ",")
    size = lambda p: F.when(p.rlike(r"^\d+-\d+$"), F.greatest(F.lit(0), F.split_part(p, F.lit("-"), F.lit(2)).cast("long") - F.split_part(p, F.lit("-"), F.lit(1)).cast("long") + 1)).otherwise(1)
    good = spec.rlike(r"^\s*\d+(\s*-\s*\d+)?(\s*,\s*\d+(\s*-\s*\d+)?)*\s*$")
    return F.when(good, F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + size(p))).otherwise(-1)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4)).cast("long")


def chunk_id(name: Column, index: Column, text: Column) -> Column:
    return F.concat(F.format_string("chunk_%04d_", index), F.substring(F.sha1(F.concat_ws(":", name, index.cast("string"), text)), 1, 12))


def stable_id(source_sha: Column, lines: Column, chars: Column, text: Column) -> Column:
    return F.concat(F.lit("stable_"), F.substring(F.sha1(F.concat_ws(":", source_sha, lines, chars, F.sha2(text, 256))), 1, 16))


def read_page(text: Column, offset: int, limit: int) -> Column:
    """struct(text, has_more, next_offset) of a page read."""
    end = F.lit(offset + limit)
    more = F.length(text) > end
    return F.struct(F.substring(text, offset + 1, limit).alias("text"), more.alias("has_more"), F.when(more, end).otherwise(-1).alias("next_offset"))


def escape_cell(value: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit("<br>"))


def table_row(cells: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[escape_cell(c) for c in cells]), F.lit(" |"))


def clean_mail(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\x00", ""))
