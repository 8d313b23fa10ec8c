"""Recursive archives against a plain recursive walk."""

import io
import random
import zipfile

import pytest

from loomspan.sources import archives as A
from loomspan.sources.converters import default_registry


def packed(items):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in items:
            z.writestr(name, data)
    return out.getvalue()


def walk(data, limits, budget, depth=0, place=()):
    """The walk as one recursive function, child by child."""
    registry, out = default_registry(), []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for i, m in enumerate(z.infolist()):
            own = (*place, i)
            ext = A.ending(m.filename)
            say = lambda action, reason, own=own, m=m: out.append((own, m.filename, depth, action, reason))
            if i >= limits.files:
                say("skipped", "file count")
            elif budget["children"] >= limits.children:
                say("skipped", "children")
            elif m.file_size > limits.child:
                say("skipped", "child size")
            elif A.ratio(m.file_size, m.compress_size) > limits.ratio:
                say("skipped", "ratio")
            elif budget["used"] + m.file_size > limits.total:
                say("skipped", "total size")
            else:
                budget["used"] += m.file_size
                if depth >= limits.depth:
                    say("skipped", "depth")
                elif A.suspicious(m.filename):
                    say("skipped", "name")
                elif ext == ".zip":
                    try:
                        zipfile.ZipFile(io.BytesIO(z.read(m))).close()
                    except zipfile.BadZipFile:
                        say("failed", "BadZipFile")
                        continue
                    budget["children"] += 1
                    say("converted", None)
                    out += walk(z.read(m), limits, budget, depth + 1, own)
                elif registry.get(ext) is None:
                    say("skipped", "no converter")
                else:
                    try:
                        registry.get(ext)[1](z.read(m), ext)
                        budget["children"] += 1
                        say("converted", None)
                    except Exception as e:  # noqa: BLE001
                        say("failed", type(e).__name__)
    return out


def tree(draw, depth=0):
    items = []
    for i in range(draw.randrange(1, 9)):
        kind = draw.choice(["txt", "txt", "json", "bad", "bin", "zeros", "big", "evil", "zip", "zip", "broken"])
        data = {"txt": f"text {i} {draw.random()}", "json": '{"a": 1}', "bad": "{", "bin": "x", "zeros": "0" * 9000, "big": "".join(chr(97 + draw.randrange(26)) for _ in range(4000)), "evil": "x", "broken": "no zip"}
        name = {"bad": f"bad{i}.json", "evil": f"../e{i}.txt", "zip": f"n{i}.ZIP" if i % 2 else f"n{i}.zip", "broken": f"b{i}.zip", "zeros": f"z{i}.txt", "big": f"big{i}.txt"}.get(kind, f"d/{kind}{i}.{kind}")
        items.append((name, tree(draw, depth + 1) if kind == "zip" and depth < 4 else data.get(kind, "x")))
    return packed(items)


@pytest.mark.parametrize("limits", [A.Limits(), A.Limits(files=6, child=3000, depth=2, children=7, total=9000, ratio=50.0), A.Limits(depth=0), A.Limits(depth=3, children=11)])
def test_members_equal_the_walk(spark, limits):
    draw = random.Random(11)
    files = [(f"/in/a{k}.zip", bytearray(tree(draw))) for k in range(25)]
    got = {}
    for r in A.convert_archives(spark.createDataFrame(files, "path string, content binary"), limits).collect():
        reason = r.reason.split(":")[0] if r.reason and r.action == "failed" else r.reason
        got.setdefault(r.root, []).append((tuple(r.place), r.path, r.depth, r.action, reason))
        assert (r.markdown is not None) == (r.action == "converted" and not r.path.lower().endswith(".zip"))
    want = {p: sorted(walk(bytes(d), limits, {"children": 0, "used": 0})) for p, d in files}
    assert {p: sorted(v) for p, v in got.items()} == {p: v for p, v in want.items() if v}


def test_broken_and_empty_archives(spark):
    files = [("x.zip", bytearray(b"no zip")), ("empty.zip", bytearray(packed([]))), ("null.zip", None)]
    got = [(r.root, r.path, r.action, r.reason) for r in A.convert_archives(spark.createDataFrame(files, "path string, content binary")).collect()]
    assert sorted(got) == [("null.zip", None, "failed", "BadZipFile"), ("x.zip", None, "failed", "BadZipFile")]
