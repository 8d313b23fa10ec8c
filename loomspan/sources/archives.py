"""Recursive archives as a frontier of rows: each depth's members are rows of a table, nested archives are the next frontier, children are converted where there is room.

An archive and those within it share one budget, which is spent in the order of a depth-first walk: how many children, how many bytes. Members are listed depth by
depth first, by tasks; a nested archive that the limits on single members rule out isn't opened. Then one pass over the rows of each outermost archive, in order of the
walk, decides; it holds the budget only. What it admits is extracted and dealt out over all tasks. A child that fails gives its place back, so decisions
are taken again with the failures known until nothing new is admitted.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.session import Cuts
from loomspan.sources.converters import ARCHIVE, Registry, convert_files, default_registry


@dataclass(frozen=True)
class Limits:
    """files: members of one archive that are looked at; depth: archives deeper than this are listed but not converted."""

    files: int = ARCHIVE["files"]
    child: int = ARCHIVE["child"]
    depth: int = ARCHIVE["depth"]
    children: int = ARCHIVE["children"]
    total: int = ARCHIVE["total"]
    ratio: float = ARCHIVE["ratio"]


LISTED = "root string, place array<int>, name string, size bigint, packed bigint, depth int, broken string, content binary"
KINDS = [pa.string(), pa.list_(pa.int32()), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.binary()]
NAMES = [c.split()[0] for c in LISTED.split(", ")]


def suspicious(name: str) -> bool:
    """A name that leads out of the archive."""
    return name.replace("\\", "/").startswith("/") or ".." in name.replace("\\", "/").split("/")


def ending(name: str) -> str:
    last = name.rsplit("/", 1)[-1]
    return "." + last.rsplit(".", 1)[-1].lower() if "." in last[1:] else ""


def ratio(size: int, packed: int) -> float:
    return 0.0 if size <= 0 else size / packed if packed > 0 else float("inf")


def members(files: DataFrame, limits: Limits, cuts: Cuts) -> list[DataFrame]:
    """A table for each depth of members of archives (path, content): LISTED. place has the member's number in each archive on its way down. A nested archive that may be opened has its
    content; one that can't be read, and an outermost one that can't, has a row whose broken says why."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for root, place, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                rows, depth = [], len(place)
                try:
                    with zipfile.ZipFile(io.BytesIO(data.as_py() or b"")) as z:
                        for i, m in enumerate(m for m in z.infolist() if not m.is_dir()):
                            content, broken = None, None
                            opens = i < limits.files and m.file_size <= limits.child and ratio(m.file_size, m.compress_size) <= limits.ratio
                            if ending(m.filename) == ".zip" and opens and depth < limits.depth and not suspicious(m.filename):
                                try:
                                    content = z.read(m)
                                    zipfile.ZipFile(io.BytesIO(content)).close()
                                except Exception as e:  # noqa: BLE001  a broken child is recorded, not raised
                                    content, broken = None, type(e).__name__
                            rows.append((root, [*place, i], m.filename, m.file_size, m.compress_size, depth, broken, content))
                except Exception as e:  # noqa: BLE001
                    rows.append((root, place, None, None, None, depth, type(e).__name__, None))
                for k in range(0, len(rows), 50):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 50], strict=True), KINDS, strict=True)], NAMES)

    frontier = files.select(F.col("path").alias("root"), F.array().cast("array<int>").alias("place"), "content")
    found = []
    for depth in range(limits.depth + 1):
        found.append(cuts.write(frontier.mapInArrow(run, LISTED), f"depth-{depth}"))
        frontier = found[-1].where("content is not null").select("root", "place", "content")
        if depth < limits.depth and not frontier.limit(1).count():
            break
        frontier = frontier.repartition("root", "place")
    return found


DECIDED = "root string, place array<int>, name string, size bigint, depth int, action string, reason string"


def _decided(rows: DataFrame, limits: Limits, endings: frozenset[str]) -> DataFrame:
    """The walk: action (convert, skipped or failed) and reason of every member that is reached."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, children, used, closed = None, 0, 0, None
        for b in batches:
            out = []
            for own, place, name, size, packed, depth, broken, failed in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                if own != root:
                    root, children, used, closed = own, 0, 0, None
                if name is None:
                    out.append((own, place, None, None, depth, "failed", broken))
                    continue
                if closed is not None and depth > closed:
                    continue  # in an archive that wasn't opened
                closed, nested = None, ending(name) == ".zip"
                if place[-1] >= limits.files:
                    action, reason = "skipped", "file count"
                elif children >= limits.children:
                    action, reason = "skipped", "children"
                elif size > limits.child:
                    action, reason = "skipped", "child size"
                elif ratio(size, packed) > limits.ratio:
                    action, reason = "skipped", "ratio"
                elif used + size > limits.total:
                    action, reason = "skipped", "total size"
                else:
                    used += size
                    if depth >= limits.depth:
                        action, reason = "skipped", "depth"
                    elif suspicious(name):
                        action, reason = "skipped", "name"
                    elif not nested and ending(name) not in endings:
                        action, reason = "skipped", "no converter"
                    elif broken or failed:
                        action, reason = "failed", broken or failed
                    else:
                        action, reason = "convert", None
                        children += 1
                if nested and action != "convert":
                    closed = depth
                out.append((own, place, name, size, depth, action, reason))
            if out:
                kinds = [pa.string(), pa.list_(pa.int32()), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in DECIDED.split(", ")])

    rows = rows.select("root", "place", "name", "size", "packed", "depth", "broken", "failed")
    return rows.repartition("root").sortWithinPartitions("root", "place").mapInArrow(run, DECIDED)


def _extracted(wanted: DataFrame, archives: DataFrame) -> DataFrame:
    """Contents of wanted members (root, place, name), dealt out anew: path (root, place and name), content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for root, place, numbers, data in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), strict=True):
                with zipfile.ZipFile(io.BytesIO(data.as_py())) as z:
                    own = [m for m in z.infolist() if not m.is_dir()]
                    for i in sorted(numbers):
                        try:
                            content = z.read(own[i])
                        except Exception:  # noqa: BLE001  damaged bytes; the converter's error is the member's
                            content = None
                        yield pa.RecordBatch.from_arrays([pa.array([root]), pa.array([[*place, i]], pa.list_(pa.int32())), pa.array([content], pa.binary())], ["root", "place", "content"])

    parent = F.slice("place", 1, F.size("place") - 1)
    grouped = wanted.groupBy("root", parent.alias("parent")).agg(F.collect_list(F.element_at("place", -1)).alias("numbers"))
    archives = archives.select("root", F.col("place").alias("parent"), "content")
    return grouped.join(archives, ["root", "parent"]).select("root", "parent", "numbers", "content").mapInArrow(run, "root string, place array<int>, content binary").repartition("root", "place")


def convert_archives(files: DataFrame, limits: Limits | None = None, registry: Registry | None = None) -> DataFrame:
    """Members of ZIP archives (path, content), converted as far as the budget goes: root, place, path (in its archive), size, depth, action (converted, skipped or failed),
    reason, engine, markdown.

    Paths are unique. Nested archives are converted if they are opened; their members follow them. An archive that can't be read is one failed row without a path. Empty archives have no rows. Depths
    are those of the archive that holds the member, from 0.
    """
    limits, registry = limits or Limits(), registry or default_registry()
    cuts = Cuts(files.sparkSession)
    levels = members(files, limits, cuts)
    listed = reduce(DataFrame.unionByName, levels)
    outer = files.select(F.col("path").alias("root"), F.array().cast("array<int>").alias("place"), "content")
    archives = outer.unionByName(listed.where("content is not null").select("root", "place", "content"))
    endings = frozenset(registry.rows) - {".zip"}
    done = cuts.write(listed.limit(0).select("root", "place", F.lit("").alias("engine"), F.lit("").alias("markdown"), F.lit("").alias("error")), "done-0")
    k = 0
    while True:
        k += 1
        known = done.select("root", "place", F.col("error").alias("failed"))
        decided = cuts.write(_decided(listed.drop("content").join(known, ["root", "place"], "left"), limits, endings), f"decided-{k}")
        leaves = decided.where((F.col("action") == "convert") & ~F.lower("name").endswith(".zip"))
        todo = leaves.join(done, ["root", "place"], "left_anti")
        if not todo.limit(1).count():
            break
        path = F.concat("root", F.lit("!"), F.array_join(F.col("place").cast("array<string>"), "/"), F.lit("/"), "name")
        named = todo.select("root", "place", path.alias("path"))
        got = _extracted(todo, archives).join(named, ["root", "place"])
        made = convert_files(got.select("path", "content"), registry).drop("metadata").join(named, "path")
        done = done.unionByName(cuts.write(made.select("root", "place", "engine", "markdown", "error"), f"done-{k}"))
    found = decided.join(done, ["root", "place"], "left")
    nested = F.lower("name").endswith(".zip")
    return found.select("root", "place", F.col("name").alias("path"), "size", "depth", F.when(F.col("action") == "convert", "converted").otherwise(F.col("action")).alias("action"), "reason", F.when(nested & (F.col("action") == "convert"), "archive").otherwise(F.col("engine")).alias("engine"), "markdown")
