"""Output sink: several formats from one parse, with checksums, published by a manifest that is written last.

A task writes the files of its rows into a folder of its own and names it by its partition and the digest of what it holds. The driver
then writes one manifest that lists these folders. Readers go by the manifest, so tasks that were killed, ran twice or belong to a job that failed
leave nothing that is seen, and the driver's work grows with the tasks, not with the files. Tasks reach the folder through its URI.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from loomspan.operators.markdown import chunk

VERSION = "output_manifest.v1"
MANIFEST = "_manifest.json"
#: Formats and their endings and media types (fixed values).
FORMATS = {"markdown": (".md", "text/markdown"), "json": (".json", "application/json"), "chunks": (".chunks.json", "application/json")}
COLUMNS = "name", "source", "text", "metadata"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _put(files: fs.FileSystem, path: str, data: bytes) -> None:
    with files.open_output_stream(path) as f:
        f.write(data)


def rendered(text: str, metadata: str | None, wanted: list[str]) -> dict[str, bytes]:
    """The formats in the order they were asked for. Chunks and JSON are made from the one text; a format that can't be made is an error."""
    out = {}
    for kind in wanted:
        if kind == "markdown":
            made = text
        elif kind == "json":
            made = json.dumps({"markdown": text, "metadata": json.loads(metadata or "{}")}, ensure_ascii=False, sort_keys=True)
        else:
            made = json.dumps({"chunks": chunk(text)}, ensure_ascii=False, sort_keys=True, default=list)
        out[kind] = made.encode("utf-8", "surrogatepass")
    return out


@dataclass
class Part(WriterCommitMessage):
    folder: str
    rows: int
    sha256: str


class OutputWriter(DataSourceWriter):
    """write runs in tasks, commit and abort on the driver."""

    def __init__(self, path: str, formats: list[str], overwrite: bool):
        self.path, self.formats, self.overwrite = path, formats, overwrite

    def write(self, rows: Iterator[Row]) -> Part:
        files, root = _store(self.path)
        own = f"{root}/_task-{uuid.uuid4().hex}"
        files.create_dir(own)
        try:
            entries = [self._entry(files, own, r) for r in rows]
            if len({e["name"] for e in entries}) < len(entries):
                raise ValueError("a name occurs twice")
        except BaseException:
            files.delete_dir(own)
            raise
        if not entries:
            files.delete_dir(own)
            return Part("", 0, "")
        entries.sort(key=lambda e: e["name"])
        listing = "".join(json.dumps(e, sort_keys=True) + "\n" for e in entries).encode()
        _put(files, f"{own}/entries.jsonl", listing)
        sha = hashlib.sha256(listing).hexdigest()
        folder = f"part-{TaskContext.get().partitionId():05d}-{sha[:16]}"
        if files.get_file_info(f"{root}/{folder}/entries.jsonl").type == fs.FileType.File:
            files.delete_dir(own)  # the same rows were written before, by this task's other attempt or by an earlier run
        else:
            files.move(own, f"{root}/{folder}")
        return Part(folder, len(entries), sha)

    def _entry(self, files: fs.FileSystem, folder: str, r: Row) -> dict:
        if r["text"] is None:
            raise ValueError(f"no text to write for {r['name']}")
        if not r["name"] or "/" in r["name"] or r["name"].startswith("_"):
            raise ValueError(f"not a file name: {r['name']}")
        outputs = []
        for kind, data in rendered(r["text"], r["metadata"], self.formats).items():
            ending, media = FORMATS[kind]
            _put(files, f"{folder}/{r['name']}{ending}", data)
            outputs.append({"format": kind, "file": f"{r['name']}{ending}", "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest(), "media_type": media})
        return {"schema_version": VERSION, "name": r["name"], "source": r["source"], "outputs": outputs}

    def commit(self, messages: list[Part | None]) -> None:
        files, root = _store(self.path)
        parts = [] if self.overwrite else read_manifest(self.path)["parts"]
        parts = {p["folder"]: p for p in parts} | {m.folder: vars(m) for m in messages if m is not None and m.rows}
        data = json.dumps({"schema_version": VERSION, "formats": self.formats, "rows": sum(p["rows"] for p in parts.values()), "parts": [parts[k] for k in sorted(parts)]}, sort_keys=True)
        _put(files, f"{root}/_next-{MANIFEST}", data.encode())
        files.move(f"{root}/_next-{MANIFEST}", f"{root}/{MANIFEST}")

    def abort(self, messages: list[Part | None]) -> None:
        """Removes what the tasks that ended have written, unless an earlier job published it; of killed tasks nothing is listed (see clean)."""
        files, root = _store(self.path)
        listed = {p["folder"] for p in read_manifest(self.path)["parts"]}
        for m in messages:
            if m is not None and m.rows and m.folder not in listed and files.get_file_info(f"{root}/{m.folder}").type == fs.FileType.Directory:
                files.delete_dir(f"{root}/{m.folder}")


class Outputs(DataSource):
    """``df.write.format("loomspan_outputs").option("path", ...).option("formats", "markdown,chunks")``; df has name, source, text and metadata (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "loomspan_outputs"

    def writer(self, schema: StructType, overwrite: bool) -> OutputWriter:
        wanted = [f.strip() for f in self.options.get("formats", "markdown").split(",")]
        if unknown := [f for f in wanted if f not in FORMATS]:
            raise ValueError(f"no such output format: {', '.join(unknown)}")
        if missing := [c for c in COLUMNS if c not in schema.names]:
            raise ValueError(f"missing columns: {', '.join(missing)}")
        return OutputWriter(self.options["path"], list(dict.fromkeys(wanted)), overwrite)


def read_manifest(path: str) -> dict:
    """The published manifest; one without parts where nothing was published or the schema version is another."""
    files, root = _store(path)
    if files.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
        with files.open_input_stream(f"{root}/{MANIFEST}") as f:
            found = json.loads(f.read())
        if found.get("schema_version") == VERSION:
            return found
    return {"schema_version": VERSION, "formats": [], "rows": 0, "parts": []}


def clean(path: str) -> None:
    """Removes folders that the manifest doesn't list. Not to be called while a job writes."""
    files, root = _store(path)
    listed = {p["folder"] for p in read_manifest(path)["parts"]}
    for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if f.type == fs.FileType.Directory and f.base_name not in listed and f.base_name.startswith(("part-", "_task-")):
            files.delete_dir(f.path)


def write_formats(df: DataFrame, path: str, formats: list[str], mode: str = "overwrite") -> None:
    """Writes name, source, text, metadata in these formats. Names are unique (see output_names); a null text fails the job and publishes nothing."""
    spark = df.sparkSession
    spark.dataSource.register(Outputs)
    df.select(*COLUMNS).write.format(Outputs.name()).mode(mode).option("path", path).option("formats", ",".join(formats)).save()


ENTRY = "schema_version string, name string, source string, outputs array<struct<format:string,file:string,bytes:bigint,sha256:string,media_type:string>>"


def read_outputs(spark: SparkSession, path: str) -> DataFrame:
    """What the manifest lists: name, source, format, file (with its folder), bytes, sha256, media_type. Entries of another schema version are left out."""
    parts = [f"{path}/{p['folder']}/entries.jsonl" for p in read_manifest(path)["parts"]]
    if not parts:
        return spark.createDataFrame([], "name string, source string, format string, file string, bytes bigint, sha256 string, media_type string")
    rows = spark.read.schema(ENTRY).json(parts).selectExpr("*", "_metadata.file_path as entries").where(f"schema_version = '{VERSION}'")
    return rows.selectExpr("name", "source", "entries", "inline(outputs)").selectExpr("name", "source", "format", "concat(regexp_extract(entries, '[^/]+(?=/[^/]+$)', 0), '/', file) as file", "bytes", "sha256", "media_type")
