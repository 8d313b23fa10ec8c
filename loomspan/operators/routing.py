"""Routing rules: format registry, page scores, engine choice, page coverage and segments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.functions import lexicons as L

#: Extension, MIME type, engine, category, confidence, whether neural models are needed (fixed values).
REGISTRY = (
    (".pdf", "application/pdf", "deep_pdf", "document", 0.75, True), (".jpg", "image/jpeg", "deep_pdf", "image", 1.0, True), (".jpeg", "image/jpeg", "deep_pdf", "image", 1.0, True),
    (".png", "image/png", "deep_pdf", "image", 1.0, True), (".webp", "image/webp", "deep_pdf", "image", 1.0, True), (".tiff", "image/tiff", "deep_pdf", "image", 1.0, True),
    (".bmp", "image/bmp", "deep_pdf", "image", 1.0, True), (".gif", "image/gif", "deep_pdf", "image", 1.0, True), (".epub", "application/epub+zip", "deep_pdf", "ebook", 1.0, True),
    (".wav", "audio/wav", "audio", "audio", 0.95, False), (".mp3", "audio/mpeg", "audio", "audio", 0.95, False), (".m4a", "audio/mp4", "audio", "audio", 0.95, False),
    (".flac", "audio/flac", "audio", "audio", 0.95, False), (".ogg", "audio/ogg", "audio", "audio", 0.95, False), (".aac", "audio/aac", "audio", "audio", 0.95, False),
    (".mp4", "video/mp4", "video", "video", 0.90, False), (".mov", "video/quicktime", "video", "video", 0.90, False), (".mkv", "video/x-matroska", "video", "video", 0.90, False),
    (".webm", "video/webm", "video", "video", 0.90, False), (".avi", "video/x-msvideo", "video", "video", 0.90, False),
    (".docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "office_docx", "office", 0.95, False),
    (".pptx", "application/vnd.openxmlformats-officedocument.presentationml.presentation", "office_pptx", "office", 0.95, False), (".msg", "application/vnd.ms-outlook", "outlook_msg", "email", 0.95, False),
    (".xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "spreadsheet", "office", 0.95, False), (".xls", "application/vnd.ms-excel", "spreadsheet", "office", 0.95, False),
    (".csv", "text/csv", "text_data", "data", 0.95, False), (".tsv", "text/tab-separated-values", "text_data", "data", 0.95, False), (".json", "application/json", "text_data", "data", 0.95, False),
    (".jsonl", "application/x-ndjson", "text_data", "data", 0.95, False), (".xml", "application/xml", "xml_rss", "data", 0.90, False), (".rss", "application/rss+xml", "xml_rss", "data", 0.90, False),
    (".atom", "application/atom+xml", "xml_rss", "data", 0.90, False), (".html", "text/html", "html", "document", 0.90, False), (".htm", "text/html", "html", "document", 0.90, False),
    (".txt", "text/plain", "text_data", "text", 1.0, False), (".md", "text/markdown", "text_data", "text", 1.0, False), (".rst", "text/x-rst", "text_data", "text", 1.0, False), (".log", "text/plain", "text_data", "text", 1.0, False),
    (".ipynb", "application/x-ipynb+json", "notebook", "notebook", 0.95, False), (".zip", "application/zip", "archive", "archive", 0.90, False),
)
OUTPUT_FORMATS = ("markdown", "html", "json", "chunks")
FALLBACK = ("deep_pdf", 0.3)


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGISTRY, "extension string, mime string, engine string, category string, confidence double, needs_models boolean")


def extension(path: Column) -> Column:
    """Lower-cased suffix with its dot; empty when the name has none."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r".(\.[^.]*)$", 1))


def plan_engines(df: DataFrame, path_col: str) -> DataFrame:
    """Adds extension, engine, category, confidence, needs_models and backend, from the registry (a table of fixed size)."""
    known = F.broadcast(registry(df.sparkSession).drop("mime"))
    out = df.withColumn("extension", extension(F.col(path_col))).join(known, "extension", "left")
    out = out.withColumn("known", F.col("engine").isNotNull())
    out = out.withColumn("engine", F.coalesce("engine", F.lit(FALLBACK[0]))).withColumn("confidence", F.coalesce("confidence", F.lit(FALLBACK[1])))
    return out.withColumn("needs_models", F.coalesce("needs_models", F.lit(True))).withColumn("backend", F.when(F.col("needs_models"), "model_worker").otherwise("cpu_thread"))


def by_mime(df: DataFrame, mime_col: str) -> DataFrame:
    """Adds the first registered extension of a MIME type (parameters and case are ignored)."""
    first = registry(df.sparkSession).withColumn("place", F.monotonically_increasing_id()).groupBy("mime").agg(F.min_by("extension", "place").alias("extension"))
    plain = F.trim(F.lower(F.split_part(F.col(mime_col), F.lit(";"), F.lit(1))))
    return df.join(F.broadcast(first), plain == F.col("mime"), "left").drop("mime")


def with_override(df: DataFrame, override_col: str) -> DataFrame:
    """Engine override: taken where the engine is registered for the row's extension, refused where it is known but does not fit; auto, empty and null ask for none."""
    pairs = registry(df.sparkSession).select(F.col("engine").alias("o_engine"), F.col("extension").alias("o_extension")).distinct()
    names = pairs.select(F.col("o_engine").alias("n_engine")).distinct()
    asked = F.lower(F.trim(F.coalesce(override_col, F.lit("auto"))))
    out = df.withColumn("asked", F.when(asked == "", "auto").otherwise(asked))
    out = out.join(F.broadcast(pairs), (F.col("asked") == F.col("o_engine")) & (F.col("extension") == F.col("o_extension")), "left").join(F.broadcast(names), F.col("asked") == F.col("n_engine"), "left")
    action = F.when(F.col("asked") == "auto", "none").when(F.col("o_engine").isNotNull(), "override").when(F.col("n_engine").isNotNull(), "incompatible").otherwise("unknown")
    return out.withColumn("action", action).withColumn("final_engine", F.coalesce("o_engine", "engine")).drop("o_engine", "o_extension", "n_engine")


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def text_quality(text: Column) -> Column:
    """Quality of extracted text from printable share, word density, control characters, runs of one character and white space.

    Printable are all but control and unassigned characters; white space is Unicode's.
    """
    n = F.length(text)
    controls = F.regexp_count(text, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f�]"))
    unprintable = F.regexp_count(text, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0\xad  ]"))
    spaces = F.regexp_count(text, F.lit(r"(?U)\s"))
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w.rlike(r"[\p{L}\p{N}]")))
    runs = F.aggregate(F.regexp_extract_all(text, F.lit(r"((?s:.))\1{7,}"), 0), F.lit(0), lambda a, r: a + F.length(r) - 7)
    share = spaces / n
    score = (n - unprintable) / n * 0.65 + F.least(F.lit(1.0), words / F.greatest(F.lit(1.0), n / 12)) * 0.35
    score = score - F.least(F.lit(0.5), controls / n * 8) - F.least(F.lit(0.3), runs / n * 20) - F.when((share < 0.03) | (share > 0.45), 0.25).otherwise(0.0)
    return F.when(n > 0, clamp(score)).otherwise(0.0)


def text_layer(text: Column) -> Column:
    return F.least(F.length(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")) / 900, F.lit(1.0))


def visual_complexity(images: Column, full_page: Column) -> Column:
    return clamp(images / 3.0 * 0.45 + F.when(full_page, 0.55).otherwise(0.0))


def scan_likelihood(layer: Column, full_page: Column, adjustment: Column) -> Column:
    effective = F.when((adjustment >= 0) | (layer >= 0.10), adjustment).otherwise(0.0)
    return clamp((1.0 - layer) * 0.65 + F.when(full_page, 0.35).otherwise(0.0) + effective)


def sandwich_likelihood(visual: Column, layer: Column, quality: Column) -> Column:
    return clamp(visual * 0.55 + layer * 0.25 + (1.0 - quality) * 0.20)


def metadata_adjustment(creator: Column, producer: Column) -> Column:
    """+.40 for scanner software, else -.30 for digital generators, else 0."""
    has = lambda words: reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(w)) for w in words for c in (creator, producer)])
    return F.when(has(L.SCANNER_KEYWORDS), 0.40).when(has(L.DIGITAL_KEYWORDS), -0.30).otherwise(0.0)


def layout_complexity(xs: Column, lengths: Column) -> Column:
    """Columns found by clustering sorted x positions greedily (a new cluster begins more than 90 from the head of the last), and the share of short lines."""
    n = F.size(lengths)
    ordered = F.array_sort(F.filter(F.arrays_zip(xs.alias("x"), lengths.alias("n")), lambda p: p["n"] > 2)).getField("x")
    start = F.struct(F.lit(0).alias("k"), F.lit(None).cast("double").alias("head"))
    step = lambda a, x: F.when(a["head"].isNull() | (F.abs(x - a["head"]) > 90), F.struct((a["k"] + 1).alias("k"), x.cast("double").alias("head"))).otherwise(a)
    clusters = F.aggregate(ordered, start, step, lambda a: a["k"])
    short = F.size(F.filter(lengths, lambda v: v < 12)) / n
    return F.when((n < 12) | (F.size(ordered) == 0), 0.0).otherwise(clamp(clamp((clusters - 1) / 5) * 0.65 + short * 0.35))


def is_safe(layer: Column, quality: Column, scan: Column, sandwich: Column, visual: Column, layout: Column) -> Column:
    return (layer >= 0.70) & (quality >= 0.80) & (scan <= 0.20) & (sandwich <= 0.40) & (visual <= 0.35) & (layout <= 0.45)


def route_reasons(layer: Column, quality: Column, scan: Column, sandwich: Column, visual: Column, layout: Column) -> Column:
    rules = [(layer < 0.70, "text_layer"), (quality < 0.80, "text_quality"), (scan > 0.20, "scan"), (sandwich > 0.40, "sandwich"), (visual > 0.35, "visual"), (layout > 0.45, "layout")]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))


def plan_pdf(safe: Column, probed: Column, profile: Column, forced: Column) -> Column:
    """struct(engine, confidence): forced pages go deep, a fast profile goes fast, else the scores decide."""
    made = lambda e, c: F.struct(F.lit(e).alias("engine"), F.lit(c).alias("confidence"))
    fast = F.lower(profile).isin("fast", "fast_path", "fast-path")
    hard = forced | F.lower(profile).isin("high_accuracy", "high-accuracy", "accuracy")
    return F.when(fast & ~hard & probed, made("fast_pdf", 0.65)).when(fast & ~hard, made("fast_pdf", 0.55)).when(probed & safe & ~hard, made("fast_pdf", 0.92)).when(probed | hard, made("deep_pdf", 1.0)).otherwise(made("deep_pdf", 0.75))


def sample_pages(page: Column, total: Column, extended: Column) -> Column:
    """Whether a page (from 0) is sampled: the first three and the last; extended takes up to eight evenly spaced ones."""
    first = (page < 3) | (page == total - 1)
    spaced = F.when(total <= 8, True).otherwise(F.exists(F.sequence(F.lit(0), F.lit(7)), lambda k: F.floor(k * (total - 1) / 7) == page))
    return F.when(extended, first | spaced).otherwise(first)


def missing_pages(pages: DataFrame, totals: DataFrame) -> DataFrame:
    """Pages of 1..page_count that a document lacks: doc, page."""
    want = totals.select("doc", F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page"))
    return want.join(pages.select("doc", "page").distinct(), ["doc", "page"], "left_anti")


def segments(pages: DataFrame) -> DataFrame:
    """Runs of successive pages of one engine: doc, segment, engine, first_page, last_page, pages."""
    w = W.partitionBy("doc").orderBy("page")
    turn = F.when((F.lag("engine").over(w) == F.col("engine")) & (F.lag("page").over(w) == F.col("page") - 1), 0).otherwise(1)
    runs = pages.withColumn("turn", turn).withColumn("segment", F.sum("turn").over(w))
    return runs.groupBy("doc", "segment", "engine").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("pages"))


def page_ranges(pages: DataFrame) -> DataFrame:
    """Distinct positive pages of a document as ranges like 1-3,5."""
    w = W.partitionBy("doc").orderBy("page")
    own = pages.select("doc", "page").where("page > 0").distinct().withColumn("run", F.col("page") - F.row_number().over(w))
    runs = own.groupBy("doc", "run").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    label = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    said = F.transform(F.array_sort(F.collect_list(F.struct("a", label.alias("label")))), lambda x: x["label"])
    return runs.groupBy("doc").agg(F.array_join(said, ",").alias("page_range"))


def output_formats(asked: Column) -> Column:
    """Comma-separated formats: trimmed, lower-cased, known ones once each in order; none: markdown."""
    known = F.array(*[F.lit(f) for f in OUTPUT_FORMATS])
    own = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(asked, F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: F.array_contains(known, x)))
    return F.when(F.size(own) == 0, F.array(F.lit("markdown"))).otherwise(own)


def short_output(text: Column, pages: Column) -> Column:
    """Whether a fast engine's output is so short that the deep one has to run."""
    return F.length(F.trim(text)) < F.greatest(F.lit(100), 100 * pages)


def crop_box(box: list[Column], width: Column, height: Column, normalised: Column) -> list[Column]:
    """Left, top, right, bottom in pixels, inside the page."""
    sides = (width, height, width, height)
    pixel = [F.when(normalised, b * s).otherwise(b) for b, s in zip(box, sides, strict=True)]
    return [F.greatest(F.lit(0), F.least(s, F.floor(p))).cast("long") for p, s in zip(pixel, sides, strict=True)]


def document_probe(pages: DataFrame, by: str) -> DataFrame:
    """Scores of documents from their probed pages (by, chars, quality, images, full_page, layout, sandwich, creator, producer): pages, text layer and quality, scan and sandwich likelihood, layout and
    visual complexity, each from 0 to 1, the engine that they recommend and the reasons.

    Creator and producer are the document's, the same on all of its pages; the first by name is taken. Digital generators lower the scan likelihood only where there is some text layer.
    """
    clamped = lambda c: clamp(F.coalesce(c, F.lit(0.0)))
    sums = pages.groupBy(by).agg(F.count("*").alias("pages"), F.avg("chars").alias("c"), (F.count_if(F.col("chars") >= 80) / F.count("*")).alias("h"), F.avg("quality").alias("q"), F.avg("images").alias("i"), (F.count_if("full_page") / F.count("*")).alias("f"), F.avg("layout").alias("l"), F.avg("sandwich").alias("s"), F.min("creator").alias("creator"), F.min("producer").alias("producer"))
    rows = sums.withColumns({"layer": clamped(F.col("h") * 0.55 + F.least(F.col("c") / 900, F.lit(1.0)) * 0.45), "meta": metadata_adjustment(F.col("creator"), F.col("producer"))})
    effective = F.when((F.col("meta") >= 0) | (F.col("layer") >= 0.10), F.col("meta")).otherwise(0.0)
    rows = rows.withColumns({"quality": clamped(F.col("q")), "scan": clamped((1 - F.col("layer")) * 0.65 + F.col("f") * 0.35 + effective), "sandwich": clamped(F.col("s")), "visual": clamped(F.col("i") / 3 * 0.45 + F.col("f") * 0.55), "layout": clamped(F.col("l"))})
    scores = [F.col(c) for c in ("layer", "quality", "scan", "sandwich", "visual", "layout")]
    names = {"layer": "text_layer_score", "quality": "text_quality_score", "scan": "scan_likelihood", "sandwich": "sandwich_likelihood", "layout": "layout_complexity_score", "visual": "visual_complexity_score"}
    told = F.when(effective > 0, "metadata_scanner").when(effective < 0, "metadata_digital")
    reasons = F.array_compact(F.concat(route_reasons(*scores), F.array(told)))
    return rows.select(by, "pages", *[F.round(k, 3).alias(v) for k, v in names.items()], F.when(is_safe(*scores), "fast_pdf").otherwise("deep_pdf").alias("recommended_engine"), F.array_join(reasons, ",").alias("reasons"))
