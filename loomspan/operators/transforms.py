"""Where a page's operator stream puts its images, and how much of its text lies on them.

Operators are ``q`` and ``Q`` (save and restore), ``cm`` (a transform before the current one) and ``Do`` (draw). The current transform of a page is a stack; what a
stretch of operators does to any stack is again a few numbers: how many saved transforms it takes off, and the transforms that it leaves, relative to
the one then on top. So pages are cut anywhere, each range of rows is summed up, the sums of one page's ranges are put together in
order, and each range is walked again from the stack it begins with.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.operators.scan import open_depths
from loomspan.session import Cuts

UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
#: Shares of a page's area, and the margin of a box in points (fixed values).
FULL, LARGE, MARGIN = 0.70, 0.40, 5.0
#: Cells of a page's side.
GRID = 16


def times(m: tuple, n: tuple) -> tuple:
    """The transform that applies m, then n."""
    a, b, c, d, e, f = m
    g, h, i, j, k, l = n  # noqa: E741
    return a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + l


class Walk:
    """The stack of one page, or of a stretch of it relative to what lies below: the last is the current transform."""

    def __init__(self, stack: list[tuple]):
        self.stack, self.taken = stack, 0

    def step(self, op: str, m: list[float] | None) -> None:
        if op == "q":
            self.stack.append(self.stack[-1])
        elif op == "Q":
            if len(self.stack) > 1:
                self.stack.pop()
            else:
                self.taken, self.stack = self.taken + 1, [UNIT]
        elif op == "cm" and m is not None and len(m) == 6:
            self.stack[-1] = times(tuple(m), self.stack[-1])

    def upon(self, below: list[tuple]) -> list[tuple]:
        """The stack after this stretch, where the one before it was this."""
        base = below[len(below) - 1 - self.taken]
        return [*below[: len(below) - 1 - self.taken], *(times(m, base) for m in self.stack)]


def box(ctm: tuple) -> tuple[float, float, float, float]:
    """Bounds of the unit square under a transform."""
    a, b, c, d, e, f = ctm
    xs, ys = (e, a + e, c + e, a + c + e), (f, b + f, d + f, b + d + f)
    return min(xs), min(ys), max(xs), max(ys)


def image_boxes(ops: DataFrame, cuts: Cuts) -> DataFrame:
    """Boxes of drawn images: page, seq, x0, y0, x1, y1.

    ops: page, seq (unique in a page), op, m (six numbers, for cm), image (whether a Do draws an image). A restore without a save is passed over, as is a cm without six
    numbers. Pages are not null.
    """
    known = open_depths(ops.select("page", "seq", "op", "m", "image"), "page", ["seq"], F.col("op") == "q", F.col("op") == "Q", cuts, "operators")
    rows = known.where(~F.col("unmatched") & F.col("op").isin("q", "Q", "cm", "Do")).select("page", "seq", "op", "m", "image", "_part", "_at")
    rows = rows.repartition("_part").sortWithinPartitions("_part", "_at")
    page = ops.schema["page"].dataType
    number = "array<array<double>>"

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the first and the last page of each range do; pages between these lie in one range."""
        for kind, own in _runs(batches):
            kept = {k: v for k, v in own.items() if k in (next(iter(own)), next(reversed(own)))}
            columns = list(zip(*[(p, part, w.taken, [list(m) for m in w.stack]) for (part, p), w in kept.items()], strict=True))
            kinds = [kind, pa.int64(), pa.int64(), pa.list_(pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page", "part", "taken", "stack"])

    schema = T.StructType([T.StructField("page", page), *T._parse_datatype_string(f"part bigint, taken bigint, stack {number}").fields])
    begins, before = {}, {}
    for r in sorted(rows.mapInArrow(stretches, schema).collect(), key=lambda r: r.part):  # two rows a range at most
        below = before.get(r.page, [UNIT])
        begins[r.part, r.page] = below
        walk = Walk([tuple(m) for m in r.stack])
        walk.taken = r.taken
        before[r.page] = walk.upon(below)
    held = ops.sparkSession.sparkContext.broadcast({k: v for k, v in begins.items() if v != [UNIT]})

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, walk = None, None
        for b in batches:
            out = []
            for i, (p, op, m, image, part) in enumerate(zip(*(b.column(j).to_pylist() for j in (0, 2, 3, 4, 5)), strict=True)):
                if key != (part, p):
                    key = part, p
                    walk = Walk(list(held.value.get(key, [UNIT])))
                if op == "Do":
                    if image:
                        out.append((i, *box(walk.stack[-1])))
                else:
                    walk.step(op, m)
            if out:
                at, *sides = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), *[pa.array(s, pa.float64()) for s in sides]], ["page", "seq", "x0", "y0", "x1", "y1"])

    schema = T.StructType([T.StructField("page", page), ops.schema["seq"], *T._parse_datatype_string("x0 double, y0 double, x1 double, y1 double").fields])
    return cuts.write(rows.mapInArrow(boxes, schema), "boxes")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.DataType, dict]]:
    """The walks of a range's pages, of which only the first and the last are kept; ranges one after another."""
    own: dict = {}
    kind = None
    for b in batches:
        kind = b.column(0).type
        for p, op, m, part in zip(*(b.column(j).to_pylist() for j in (0, 2, 3, 5)), strict=True):
            if own and next(iter(own))[0] != part:
                yield kind, own
                own = {}
            if (part, p) not in own:
                if len(own) == 2:
                    own.pop(next(reversed(own)))
                own[part, p] = Walk([UNIT])
            if op != "Do":
                own[part, p].step(op, m)
    if own:
        yield kind, own


def sandwich(ops: DataFrame, texts: DataFrame, pages: DataFrame) -> DataFrame:
    """Images and the text on them: page, image_count, full_page_count, sandwich_ratio, for every page of pages (page, width, height).

    texts: page, x, y, chars. An image is full-page from FULL of the page's area, large from LARGE; the ratio is the share of characters that lie in a large image, MARGIN
    around it included, 0 where there are none. Points and boxes meet in cells of the page's grid; what lies outside of the page belongs to its outer cells.
    """
    cuts = Cuts(ops.sparkSession)
    boxes = image_boxes(ops, cuts).join(pages, "page")
    area = F.greatest(F.lit(1.0), F.col("width") * F.col("height"))
    boxes = boxes.withColumn("share", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / area)
    counts = boxes.groupBy("page").agg(F.count("*").alias("image_count"), F.count_if(F.col("share") >= FULL).alias("full_page_count"))
    cell = lambda v, side: F.least(F.greatest(F.floor(v * GRID / F.greatest(F.col(side), F.lit(1.0))), F.lit(0)), F.lit(GRID - 1))
    large = boxes.where(F.col("share") >= LARGE)
    large = large.withColumn("cx", F.explode(F.sequence(cell(F.col("x0") - MARGIN, "width"), cell(F.col("x1") + MARGIN, "width"))))
    large = large.withColumn("cy", F.explode(F.sequence(cell(F.col("y0") - MARGIN, "height"), cell(F.col("y1") + MARGIN, "height")))).select("page", "cx", "cy", "x0", "y0", "x1", "y1")
    points = texts.join(pages, "page").withColumns({"cx": cell(F.col("x"), "width"), "cy": cell(F.col("y"), "height")})
    inside = (F.col("x") >= F.col("x0") - MARGIN) & (F.col("x") <= F.col("x1") + MARGIN) & (F.col("y") >= F.col("y0") - MARGIN) & (F.col("y") <= F.col("y1") + MARGIN)
    p, q = points.alias("p"), large.alias("q")
    met = p.join(q, (F.col("p.page") == F.col("q.page")) & (F.col("p.cx") == F.col("q.cx")) & (F.col("p.cy") == F.col("q.cy")) & inside, "left_semi")
    on = met.groupBy("page").agg(F.sum("chars").alias("_on"))
    total = texts.groupBy("page").agg(F.sum("chars").alias("_all"))
    found = pages.join(counts, "page", "left").join(on, "page", "left").join(total, "page", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    return found.select("page", none("image_count").alias("image_count"), none("full_page_count").alias("full_page_count"), F.when(none("_all") == 0, 0.0).otherwise(F.round(none("_on") / F.col("_all"), 6)).alias("sandwich_ratio"))
