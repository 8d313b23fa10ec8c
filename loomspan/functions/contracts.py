"""Error codes with their exit codes, and the ranges and choices of conversion options."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Error codes and the exit codes of the command line (fixed values).
EXIT_CODES = {
    "USAGE_ERROR": 2, "INPUT_NOT_FOUND": 3, "INPUT_NOT_ALLOWED": 4, "UNSUPPORTED_FORMAT": 4, "OUTPUT_EXISTS": 11, "OUTPUT_WRITE_FAILED": 11, "CONFIG_ERROR": 5,
    "AUTH_REQUIRED": 6, "AUTH_FORBIDDEN": 6, "NETWORK_BLOCKED": 7, "NETWORK_FETCH_FAILED": 7, "URL_UNSAFE": 7, "CONVERSION_FAILED": 8, "MODEL_NOT_READY": 8,
    "MODEL_DOWNLOAD_FAILED": 8, "CLOUD_NOT_ALLOWED": 6, "TIMEOUT": 9, "CANCELLED": 9, "PARTIAL_FAILURE": 10, "NATIVE_DEPENDENCY_MISSING": 5, "INTERNAL_ERROR": 1,
}
#: Least and largest values of number options (fixed values).
RANGES = {
    "audio_low_confidence_threshold": (0, 1), "audio_beam_size": (1, None), "audio_gap_warning_ms": (0, None), "audio_min_speakers": (1, None), "audio_max_speakers": (1, None),
    "audio_text_enhancement_strength": (0, 5), "text_data_max_rows": (1, None), "chunk_max_tokens": (16, None), "archive_max_files": (1, None), "archive_inline_bytes": (1, None),
    "archive_max_child_bytes": (1, None), "archive_max_total_uncompressed_bytes": (1, None), "archive_max_compression_ratio": (1, None), "archive_max_depth": (0, None),
    "archive_max_converted_children": (1, None), "decorative_max_text_density": (0, 1), "ocr_min_text_density": (0, 1), "ocr_min_lines": (1, None), "dedup_max_distance": (0, 64),
    "vlm_crop_max_px": (64, 4096), "vlm_batch_size": (1, 64), "max_batch_retries": (0, 5), "max_chars": (0, 100_000), "progress": (0, 100),
}
#: Values that text options may have (fixed values).
CHOICES = {"image_handling_mode": ("extraction", "understanding", "both"), "conversion_profile": ("auto", "fast", "high_accuracy"), "hybrid_ocr_profile": ("balanced", "max_accuracy", "low_vram"), "smart_router_level": ("disabled", "smart", "beeg_brain")}


def exit_code(code: Column) -> Column:
    """Exit code of an error code, whatever its case; null is success, an unknown code an internal error."""
    known = F.create_map(*[F.lit(x) for kv in EXIT_CODES.items() for x in kv])
    return F.when(code.isNull(), 0).otherwise(F.coalesce(F.get(F.map_values(F.map_filter(known, lambda k, _: k == F.upper(code))), F.lit(0)), F.lit(EXIT_CODES["INTERNAL_ERROR"])))


def option_problems(options: Column) -> Column:
    """Names of the options (a map of strings) that are not numbers in their range or none of their choices, sorted; options without a value are not judged."""
    found = []
    for name, (least, most) in RANGES.items():
        value = F.try_element_at(options, F.lit(name))
        number = value.try_cast("double")
        bad = number.isNull() | (number < least)
        found.append(F.when(value.isNotNull() & (bad if most is None else bad | (number > most)), F.lit(name)))
    for name, values in CHOICES.items():
        value = F.try_element_at(options, F.lit(name))
        found.append(F.when(value.isNotNull() & ~value.isin(*values), F.lit(name)))
    return F.array_sort(F.array_compact(F.array(*found)))


def mixed_plan_blockers(options: Column) -> Column:
    """Reasons for which a job's options (a map of strings) rule out routing the pages of a file to different engines, in order of the checks."""
    get = lambda k: F.coalesce(F.try_element_at(options, F.lit(k)), F.lit(""))
    set_ = lambda k: ~F.lower(get(k)).isin("", "false", "0")
    profile = F.lower(F.when(get("conversion_profile") != "", get("conversion_profile")).otherwise(get("profile")))
    checks = [(set_("engine_override"), "engine_override"), (set_("page_range"), "page_range"), (set_("force_ocr"), "force_ocr"), (get("image_handling_mode").isin("understanding", "both"), "image_understanding"), (profile.isin("fast", "fast_path", "fast-path"), "fast_profile"), (profile.isin("high_accuracy", "high-accuracy", "accuracy"), "high_accuracy_profile"), (get("converter_cls").isin("TableConverter", "OCRConverter"), "whole_file_converter")]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in checks]))


def mixed_plan(options: Column, segments: Column, covered: Column, planned: Column, total: Column) -> Column:
    """struct(accepted, confidence, blockers): more than one segment, all pages probed and planned, and no blocker unless the routing is asked for."""
    asked = F.lower(F.coalesce(F.try_element_at(options, F.lit("enable_mixed_pdf_routing")), F.lit(""))).isin("true", "1")
    blockers = mixed_plan_blockers(options)
    tests = [asked | (F.size(blockers) == 0), segments > 1, covered == total, planned == total]
    ok = F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))
    return F.struct(ok.alias("accepted"), F.when(ok, F.when(asked, 0.8).otherwise(0.86)).alias("confidence"), blockers.alias("blockers"))
