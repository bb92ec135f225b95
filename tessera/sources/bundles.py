"""Files beside documents as a sink: ``df.write.format("document_bundle")`` writes a folder for each document and a manifest last."""

from __future__ import annotations

import base64
import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tessera.functions import text
from tessera.shipping import ship

#: What a row of the sink is: a file of a document.
SCHEMA = "doc_id string, kind string, name string, meta string, content binary"
# The kinds of files, and the folder that each goes to.
FOLDERS = {"section": "sections", "table": "tables", "image": "images", "ocr": "ocr"}
# Fixed value: columns of the list of files that a reader gives.
_LISTED = ("doc_id", "kind", "name", "meta", "bytes", "sha256")
#: Files that are read at once.
READ = 64


def _row(kind: str, key: str, name: Column, meta: dict[str, Column], content: Column) -> list[Column]:
    return [F.col(key).cast("string").alias("doc_id"), F.lit(kind).alias("kind"), name.alias("name"), F.to_json(F.struct(*(v.alias(n) for n, v in meta.items()))).alias("meta"), content.cast("binary").alias("content")]


def section_files(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """A Markdown file for each section (idx, sid, title, text)."""
    name = F.concat(F.format_string("%03d-", F.col("idx").cast("int")), text.safe_name(F.col("title")), F.lit(".md"))
    body = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    return sections.select(*_row("section", key, name, {"sid": F.col("sid"), "title": F.col("title"), "idx": F.col("idx")}, body))


def table_files(tables: DataFrame, key: str = "doc_id") -> DataFrame:
    """A Markdown file for each table (idx, markdown, and pages where they are known)."""
    name = F.format_string("table-%02d.md", F.col("idx").cast("int"))
    pages = {c: F.col(c) for c in ("page_start", "page_end") if c in tables.columns}
    return tables.select(*_row("table", key, name, {"idx": F.col("idx")} | pages, F.concat(F.col("markdown"), F.lit("\n"))))


def image_files(images: DataFrame, key: str = "doc_id") -> DataFrame:
    """The bytes of each image (idx, extension, original); of null bytes no file is made."""
    name = F.format_string("img-%02d.%s", F.col("idx").cast("int"), F.col("extension"))
    return images.where("original is not null").select(*_row("image", key, name, {"idx": F.col("idx"), "sha256": F.sha2("original", 256)}, F.col("original")))


def ocr_files(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """A JSON file for each page that was read by OCR (page_num, blocks as JSON)."""
    return pages.select(*_row("ocr", key, F.format_string("page-%04d.json", F.col("page_num").cast("int")), {"page_num": F.col("page_num")}, F.col("blocks")))


@dataclass
class _Written(WriterCommitMessage):
    """What a task has written: its own folder, and a list of files in it, so that the driver gets a line and no list."""

    task: str
    documents: int
    files: int
    ok: bool = field(default=True)


class BundleWriter(DataSourceWriter):
    """Each task writes to a folder of its own below ``_staged``; at the commit the folders are renamed to their place and the manifest is written last. A reader goes by the manifest, so after an abort, or a failure before it, nothing is there."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def _stage(self) -> str:
        return os.path.join(self.path, "_staged", self.run)

    def write(self, rows: Iterator[Any]) -> WriterCommitMessage:
        task = uuid.uuid4().hex
        top = os.path.join(self._stage(), task)
        os.makedirs(top, exist_ok=True)
        documents: set[str] = set()
        files = 0
        with open(os.path.join(top, "files.jsonl"), "w", encoding="utf-8") as listed:
            for r in rows:
                if r.kind not in FOLDERS:
                    raise ValueError(f"a file of unknown kind: {r.kind}")
                # Names are made safe once more: nothing may leave the document's folder.
                folder, name = _safe(r.doc_id), _safe(r.name)
                at = os.path.join(folder, FOLDERS[r.kind], name)
                os.makedirs(os.path.dirname(os.path.join(top, at)), exist_ok=True)
                content = bytes(r.content or b"")
                with open(os.path.join(top, at), "wb") as out:
                    out.write(content)
                listed.write(json.dumps({"doc_id": r.doc_id, "kind": r.kind, "name": r.name, "path": os.path.join(task, at), "bytes": len(content), "sha256": hashlib.sha256(content).hexdigest(), "meta": json.loads(r.meta or "{}")}, ensure_ascii=False) + "\n")
                documents.add(r.doc_id)
                files += 1
        return _Written(task, len(documents), files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        done = [m for m in messages if m is not None]
        version = 1 + max((int(n.split("-")[1].split(".")[0]) for n in os.listdir(self.path) if n.startswith("manifest-")), default=0)
        # Folders of attempts that Spark did not take stay in the stage and go with it.
        kept = []
        os.makedirs(os.path.join(self.path, "data"), exist_ok=True)
        for m in done:
            os.rename(os.path.join(self._stage(), m.task), os.path.join(self.path, "data", m.task))
            kept.append(m.task)
        before = [] if self.overwrite else _tasks(self.path)
        manifest = {"version": version, "tasks": [*before, *kept], "documents": sum(m.documents for m in done), "files": sum(m.files for m in done)}
        part = os.path.join(self.path, f"_manifest-{self.run}")
        with open(part, "w", encoding="utf-8") as out:
            json.dump(manifest, out)
        os.rename(part, os.path.join(self.path, f"manifest-{version:06d}.json"))
        shutil.rmtree(self._stage(), ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self._stage(), ignore_errors=True)


def _safe(name: str | None) -> str:
    """A name that is one part of a path; others are spelled in base 32."""
    name = name or ""
    if name and name not in (".", "..") and not any(c in name for c in '/\\\0') and len(name.encode()) <= 200 and not name.startswith("b32_"):
        return name
    return "b32_" + (base64.b32encode(name.encode()).decode().rstrip("=").lower() if len(name.encode()) < 120 else hashlib.sha256(name.encode()).hexdigest())


def _tasks(path: str) -> list[str]:
    found = sorted(n for n in os.listdir(path) if n.startswith("manifest-"))
    if not found:
        return []
    with open(os.path.join(path, found[-1]), encoding="utf-8") as f:
        return json.load(f)["tasks"]


class DocumentBundle(DataSource):
    """Options: ``path``, a folder that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "document_bundle"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> BundleWriter:
        path = self.options["path"].removeprefix("file://").removeprefix("file:")
        os.makedirs(path, exist_ok=True)
        return BundleWriter(path, overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(DocumentBundle)


def write_bundle(files: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write files (``section_files`` and so on, put together by ``unionByName``). The files of a document are written by one task where it has few, and by several where Spark splits them."""
    register(files.sparkSession)
    files.write.format("document_bundle").mode(mode).option("path", path).save()


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """The files of the last manifest: doc_id, kind, name, meta (JSON), bytes, sha256, content. Files without a manifest are not seen."""
    local = path.removeprefix("file://").removeprefix("file:")
    tasks = _tasks(local) if os.path.isdir(local) else []
    schema = "doc_id string, kind string, name string, path string, bytes long, sha256 string, meta string"
    if not tasks:
        return spark.createDataFrame([], "doc_id string, kind string, name string, meta string, bytes long, sha256 string, content binary")
    listed = spark.read.schema(schema).json([f"file://{local}/data/{t}/files.jsonl" for t in tasks])

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(0, batch.num_rows, READ):
                part = batch.slice(i, READ)
                contents = []
                for at in part.column("path").to_pylist():
                    with open(os.path.join(local, "data", at), "rb") as f:
                        contents.append(f.read())
                kept = [part.column(n) for n in _LISTED]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(contents, pa.binary())], [*_LISTED, "content"])

    # The list says where the files are, so no folder is looked through and the driver holds no paths.
    return listed.mapInArrow(read, "doc_id string, kind string, name string, meta string, bytes long, sha256 string, content binary")
