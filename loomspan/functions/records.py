"""Functions on JSON records: nested redaction and masking, request keys, media probes, model answers, evaluation samples.

Trees of any depth have no Spark type, so redaction and normal forms walk the parsed text, a batch of rows at a time; whatever has a
schema is read by from_json.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.functions import lexicons as L

#: Keys whose values are masked: these endings and these words (fixed values).
SECRET_ENDS, SECRET_WORDS = ("api_key", "api_keys"), ("secret", "token", "password", "credential", "credentials")
#: Headers that are no part of a request's key (fixed values).
LEFT_OUT = ("authorization", "x-api-key", "x-goog-api-key", "api-key", "cookie", "set-cookie", "date", "expires", "server", "x-request-id", "x-correlation-id", "content-length", "transfer-encoding", "content-encoding", "host", "connection")
#: Fields of a body that are no part of it (fixed values).
BODY_LEFT_OUT = ("model", "stream", "gemini_model_name")
#: A token of a JSON text: a mark, a string, or a number or word.
TOKEN = re.compile(r'\s*(?:([\[\]{}:,])|("(?:[^"\\\x00-\x1f]|\\.)*")|([^\s\[\]{}:,"]+))')


def parsed(text: str) -> object:
    """json.loads for records of any depth. Containers that are open are kept in a list, not on the interpreter's stack."""
    try:
        return json.loads(text)
    except RecursionError:
        pass
    text = text.rstrip(" \t\n\r")
    at, whole, open_, key, comma = 0, [], [], None, False
    open_.append(whole)
    ready = True  # whether a value may stand here
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no JSON at {at}")
        at, mark, now = m.end(), m[1], open_[-1]
        if mark in ("]", "}"):
            if len(open_) == 1 or isinstance(now, dict) != (mark == "}") or comma or key is not None:
                raise ValueError(f"no end at {at}")
            open_.pop()
            ready = False
            continue
        if mark == ",":
            if ready or len(open_) == 1:
                raise ValueError(f"no comma at {at}")
            ready = comma = True
            continue
        if not ready or mark == ":":
            raise ValueError(f"no value at {at}")
        if isinstance(now, dict) and key is None:
            colon = TOKEN.match(text, at)
            if not m[2] or not colon or colon[1] != ":":
                raise ValueError(f"no key at {at}")
            key, at, comma = json.loads(m[2]), colon.end(), False
            continue
        value = {} if mark == "{" else [] if mark == "[" else json.loads(m[2] or m[3])
        if isinstance(now, dict):
            now[key] = value
        else:
            now.append(value)
        key, comma, ready = None, False, bool(mark)
        if mark:
            open_.append(value)
    if len(open_) > 1 or len(whole) != 1:
        raise ValueError("no whole record")
    return whole[0]


def written(value: object) -> str:
    """The record in one form, keys sorted, whatever its depth."""
    form = {"sort_keys": True, "separators": (",", ":"), "ensure_ascii": False}
    try:
        return json.dumps(value, **form)
    except RecursionError:
        pass
    out: list[str] = []
    todo: list[tuple[bool, object]] = [(False, value)]
    while todo:
        plain, item = todo.pop()
        if plain:
            out.append(item)
        elif isinstance(item, dict):
            todo.append((True, "}"))
            for k in sorted(item, reverse=True):
                todo += [(False, item[k]), (True, f"{json.dumps(k, ensure_ascii=False)}:"), (True, ",")]
            todo[-1:] = [(True, "{")] if item else [todo[-1], (True, "{")]
        elif isinstance(item, list):
            todo.append((True, "]"))
            for v in reversed(item):
                todo += [(False, v), (True, ",")]
            todo[-1:] = [(True, "[")] if item else [todo[-1], (True, "[")]
        else:
            out.append(json.dumps(item, **form))
    return "".join(out)


def _walked(text: str | None, change: Callable[[object], object]) -> str | None:
    """The record, changed and written in one form; null where it is no JSON."""
    try:
        return None if text is None else written(change(parsed(text)))
    except ValueError:
        return None


def _changed(record: object, replace: Callable[[object, str], tuple[bool, object]]) -> object:
    """record with what replace gives for a value and its key; a value that it leaves (False) is walked if it is a container. Items of lists have no key."""
    top: list = [None]
    todo: list[tuple] = [(record, "", top, 0)]
    while todo:
        value, key, into, at = todo.pop()
        done, new = replace(value, key)
        if not done and isinstance(value, dict):
            new = dict.fromkeys(value)
            todo += [(v, k, new, k) for k, v in value.items()]
        elif not done and isinstance(value, list):
            new = [None] * len(value)
            todo += [(v, "", new, i) for i, v in enumerate(value)]
        into[at] = new
    return top[0]


def _clean_url(url: str) -> str:
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "") + (f":{parts.port}" if parts.port is not None else "")
    except ValueError:
        return url[: L.MAX_STRING]
    return f"{parts.scheme}://{host}{parts.path}" if parts.scheme and parts.netloc else url[: L.MAX_STRING]


def _redacted(record: object) -> object:
    def replace(value: object, key: str) -> tuple[bool, object]:
        if key and any(p in key.lower().replace("-", "_") for p in L.SENSITIVE_KEYS):
            return True, "[REDACTED]"
        if isinstance(value, str):
            return True, _clean_url(value) if "url" in key.lower() else value[: L.MAX_STRING] + "..." if len(value) > L.MAX_STRING else value
        return False, value

    return _changed(record, replace)


def _masked(record: object) -> object:
    def replace(value: object, key: str) -> tuple[bool, object]:
        if key.lower().endswith(SECRET_ENDS) or key.lower() in SECRET_WORDS:
            return True, ["****" for x in value if x] if isinstance(value, list) else "****" if value else value
        return False, value

    return _changed(record, replace)


@F.pandas_udf(T.StringType())
def redact_json(records: pd.Series) -> pd.Series:
    """Records of any depth with the values of sensitive keys replaced, URLs cleaned and long strings cut; keys sorted. Null where malformed."""
    return records.map(lambda r: _walked(r, _redacted), na_action="ignore").astype(object)


@F.pandas_udf(T.StringType())
def mask_json(records: pd.Series) -> pd.Series:
    """Records of any depth with the values of secret keys, and the items of their lists, masked; keys sorted. Null where malformed."""
    return records.map(lambda r: _walked(r, _masked), na_action="ignore").astype(object)


@F.pandas_udf(T.StringType())
def normal_body(bodies: pd.Series) -> pd.Series:
    """A request body without the fields that don't change its answer, keys sorted; one that is no object as it is."""

    def one(text: str) -> str:
        try:
            data = json.loads(text)
        except (ValueError, RecursionError):
            return text
        return json.dumps({k: v for k, v in data.items() if k not in BODY_LEFT_OUT}, sort_keys=True, separators=(",", ":")) if isinstance(data, dict) else text

    return bodies.map(one, na_action="ignore").astype(object)


def request_key(method: Column, url: Column, headers: Column, body: Column) -> Column:
    """SHA-256 over method, host and path (a model's name masked), the headers that count (a map of strings, keys sorted) and the body; null for requests that are not POST."""
    path = F.regexp_replace(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), r"/models/[^/:]+:", "/models/<model>:")
    kept = F.array_sort(F.map_entries(F.map_filter(headers, lambda k, _: ~F.lower(k).isin(*LEFT_OUT))))
    shown = F.to_json(F.map_from_entries(kept))
    material = F.concat(method, F.lit("\n"), F.lower(F.parse_url(url, F.lit("HOST"))), path, F.lit("\n"), shown, F.lit("\n"), F.coalesce(normal_body(body), F.lit("")))
    return F.when(method == "POST", F.sha2(material, 256))


_STREAM = "struct<codec_type:string,codec_name:string,sample_rate:string,channels:string,duration:string,bit_rate:string,width:string,height:string>"


def media_probe(probe: Column) -> Column:
    """struct of format, duration_s, bit_rate, audio and video codec, sample_rate, channels, width, height, has_audio, stream_count of a media probe's JSON; null where malformed."""
    p = F.from_json(probe, f"streams array<{_STREAM}>, format struct<format_name:string,duration:string,bit_rate:string>")
    streams = F.coalesce(p["streams"], F.array().cast(f"array<{_STREAM}>"))
    first = lambda kind: F.get(F.filter(streams, lambda s: s["codec_type"] == kind), F.lit(0))
    audio, video = first("audio"), first("video")
    given = lambda *v: F.coalesce(*[F.when(~x.isin("", "0"), x) for x in v], F.lit("0"))
    whole = lambda v: v.try_cast("double").cast("long")
    made = F.struct(
        p["format"]["format_name"].alias("format"),
        F.round(given(video["duration"], audio["duration"], p["format"]["duration"]).try_cast("double"), 6).alias("duration_s"),
        whole(given(audio["bit_rate"], p["format"]["bit_rate"])).alias("bit_rate"),
        audio["codec_name"].alias("audio_codec"),
        video["codec_name"].alias("video_codec"),
        whole(audio["sample_rate"]).alias("sample_rate"),
        whole(audio["channels"]).alias("channels"),
        F.coalesce(whole(video["width"]), F.lit(0)).alias("width"),
        F.coalesce(whole(video["height"]), F.lit(0)).alias("height"),
        audio.isNotNull().alias("has_audio"),
        F.size(streams).cast("long").alias("stream_count"),
    )
    return F.when(p.isNotNull() & (p["streams"].isNotNull() | p["format"].isNotNull()), made)


def json_part(answer: Column) -> Column:
    """The JSON in a model's answer: without a fence around it, else from the first bracket to the last that closes it."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(answer), r"^```[^\n]*\n", ""), r"\n?```\s*$", "")
    found = F.regexp_extract(plain, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.when(F.trim(plain).rlike(r"^[\[{]"), F.trim(plain)).when(found != "", found).otherwise(plain)


def token_usage(answer: Column) -> Column:
    """struct(prompt_tokens, completion_tokens) of a response, whichever of the two common spellings it has; 0 where absent or no number."""
    get = lambda *names: F.coalesce(*[F.get_json_object(answer, f"$.usage.{n}").try_cast("long") for n in names], F.lit(0))
    return F.struct(get("prompt_tokens", "input_tokens").alias("prompt_tokens"), get("completion_tokens", "output_tokens").alias("completion_tokens"))


SAMPLE = "struct<sample_id:string,golden_text:string,golden_path:string,candidate_text:string,candidate_path:string>"


def eval_samples(manifest: Column, version: str = "eval_manifest.v1") -> Column:
    """struct(name, problem, samples) of an evaluation manifest: its schema version must fit, it needs a sample, and each sample an id and both texts or the paths to them."""
    m = F.from_json(manifest, f"schema_version string, name string, samples array<{SAMPLE}>")
    samples = F.coalesce(m["samples"], F.array().cast(f"array<{SAMPLE}>"))
    lacks = lambda s, k: s[f"{k}_text"].isNull() & (F.coalesce(s[f"{k}_path"], F.lit("")) == "")
    problem = F.when(m["schema_version"].isNull() | (m["schema_version"] != version), "version").when(F.size(samples) == 0, "no_samples")
    problem = problem.when(F.exists(samples, lambda s: F.trim(F.coalesce(s["sample_id"], F.lit(""))) == ""), "sample_id")
    problem = problem.when(F.exists(samples, lambda s: lacks(s, "golden") | lacks(s, "candidate")), "text_or_path")
    return F.struct(m["name"].alias("name"), problem.alias("problem"), samples.alias("samples"))
