"""Uploading a corpus of files, all of it or nothing.

Every row becomes one object below ``uri``. Tasks write the objects of a run
into a folder of its own and a list of what they wrote; when all have ended,
a manifest that names these lists is written last, and only runs with a
manifest count. So readers see a run when it is complete, and nothing of one
that failed. A task that is run again, or twice at the same time, writes under
a name of its own, and only the attempt that Spark accepted is in the manifest.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .files import _filesystem

FORMAT = "corpus_upload"
MANIFESTS, OBJECTS = "_manifests", "_objects"

# Lines of a list of objects are written in pieces of about so many.
_LINES = 10_000


@dataclass
class Written(WriterCommitMessage):
    part: str
    files: int
    length: int


def _write(uri: str, data: bytes) -> None:
    system, path = _filesystem(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(data)


def clean_key(path: str) -> str:
    """The key of an object: forward slashes, no empty parts, and nothing that leads out of the folder."""
    parts = [p for p in re.split(r"[/\\]+", path) if p not in ("", ".")]
    if not parts or ".." in parts:
        raise ValueError(f"not a relative path: {path!r}")
    return "/".join(parts)


class UploadWriter(DataSourceWriter):
    def __init__(self, root: str, overwrite: bool) -> None:
        self.root, self.overwrite, self.run = root, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        part, lines, files, length, piece = uuid.uuid4().hex, [], 0, 0, 0

        def flush() -> None:
            nonlocal lines, piece
            _write(f"{self.root}/{OBJECTS}/{self.run}/{part}/_list-{piece:05}.jsonl", "".join(lines).encode())
            lines, piece = [], piece + 1

        for row in iterator:
            key, content = clean_key(row["rel_path"]), bytes(row["content"] or b"")
            at = f"{OBJECTS}/{self.run}/{part}/{files}/{key}"
            _write(f"{self.root}/{at}", content)
            lines.append(json.dumps({"rel_path": key, "at": at, "length": len(content)}) + "\n")
            files, length = files + 1, length + len(content)
            if len(lines) >= _LINES:
                flush()
        if lines:
            flush()
        return Written(part, files, length)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        manifest = {
            "run": self.run, "overwrite": self.overwrite, "parts": [m.part for m in done if m.files],
            "files": sum(m.files for m in done), "length": sum(m.length for m in done),
        }
        # runs in the order of their numbers; of two that end at once only one gets a number
        system, folder = _filesystem(f"{self.root}/{MANIFESTS}")
        system.create_dir(folder, recursive=True)
        number = max([n for n, _ in manifests(self.root)], default=0) + 1
        _write(f"{self.root}/{MANIFESTS}/{number:010}-{self.run}.json", json.dumps(manifest).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, path = _filesystem(f"{self.root}/{OBJECTS}/{self.run}")
        try:
            system.delete_dir(path)
        except OSError:  # nothing was written
            pass


class Upload(DataSource):
    """``df.write.format(FORMAT).mode("append" or "overwrite").save(uri)`` of ``rel_path, content``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "rel_path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> UploadWriter:
        return UploadWriter(self.options["path"].rstrip("/"), overwrite)


def upload(files: DataFrame, uri: str, mode: str = "append") -> None:
    """Write ``content`` (or else ``text``) of each row as an object under its ``rel_path``.

    Backslashes become slashes. With ``overwrite`` the new run replaces what
    earlier ones wrote, else it adds to it; of equal paths the latest run's
    object counts, and within a run any one.
    """
    files.sparkSession.dataSource.register(Upload)
    content = F.col("content") if "content" in files.columns else F.col("text").cast("binary")
    rows = files.select("rel_path", content.alias("content"))
    rows.write.format(FORMAT).mode(mode).save(uri)


def manifests(uri: str) -> list[tuple[int, dict]]:
    """Numbers and manifests of the complete runs, one small file for each."""
    from pyarrow import fs

    system, folder = _filesystem(f"{uri.rstrip('/')}/{MANIFESTS}")
    if system.get_file_info(folder).type == fs.FileType.NotFound:
        return []
    out = []
    for info in system.get_file_info(fs.FileSelector(folder)):
        with system.open_input_stream(info.path) as stream:
            out.append((int(info.base_name.split("-")[0]), json.loads(stream.read())))
    return sorted(out, key=lambda m: (m[0], m[1]["run"]))


def uploaded(spark: SparkSession, uri: str, project_id: str = "") -> DataFrame:
    """``project_id, rel_path, uri, length`` of all objects of the complete runs, to be read with ``read_contents``."""
    root, runs = uri.rstrip("/"), manifests(uri)
    last = max((k for k, (_, m) in enumerate(runs) if m["overwrite"]), default=0)
    parts = [(k, f"{root}/{OBJECTS}/{m['run']}/{p}/_list-*.jsonl") for k, (_, m) in enumerate(runs) if k >= last for p in m["parts"]]
    columns = "project_id string, rel_path string, uri string, length long"
    if not parts:
        return spark.createDataFrame([], columns)
    # one row for each run
    order = spark.createDataFrame([(m["run"], k) for k, (_, m) in enumerate(runs)], "_name string, _run int")
    lines = _lists(spark, [p for _, p in parts]).withColumn("_name", F.split_part("at", F.lit("/"), F.lit(2)))
    lines = lines.join(F.broadcast(order), "_name")
    newest = lines.groupBy("rel_path").agg(F.max_by(F.struct("at", "length"), F.struct("_run", "at")).alias("_o"))
    return newest.select(
        F.lit(project_id).alias("project_id"), "rel_path", F.concat(F.lit(f"{root}/"), "_o.at").alias("uri"), "_o.length"
    )


def _lists(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """The lists of objects. Spark's readers skip names with an underscore, so tasks read them by name."""
    schema = "rel_path string, at string, length long"

    def run(batches):
        import pandas as pd
        from pyarrow import fs

        for batch in batches:
            for pattern in batch["pattern"]:
                system, folder = _filesystem(pattern.rsplit("/", 1)[0])
                for info in system.get_file_info(fs.FileSelector(folder)):
                    if info.base_name.startswith("_list-"):
                        with system.open_input_stream(info.path) as stream:
                            rows = [json.loads(line) for line in stream.read().decode().splitlines()]
                        yield pd.DataFrame(rows, columns=["rel_path", "at", "length"])

    named = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    return named.repartition(min(len(patterns), 4 * spark.sparkContext.defaultParallelism)).mapInPandas(run, schema)


