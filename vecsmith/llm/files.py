"""Files written by tasks into shared storage: temporary names, then a manifest and renames.

A task attempt writes under a temporary name of its own and returns a manifest
row. Only rows of attempts that Spark accepted reach the stored manifest, and
only these files are renamed, so lost executors and repeated attempts leave no
trace. A folder is complete when it holds ``manifest.json``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecsmith.llm.common import filesystem, stored


class ShardFile:
    """One file under a temporary name; ``size`` counts the bytes written."""

    def __init__(self, folder: str):
        self.fs, root = filesystem(folder)
        self.fs.create_dir(f"{root}/_temporary", recursive=True)
        self.temporary = f"_temporary/{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(f"{root}/{self.temporary}")
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()


def _renamed(batches, folder: str):
    from pyarrow.fs import FileType

    fs, root = filesystem(folder)
    for batch in batches:
        for old, new in zip(batch["temporary"], batch["name"], strict=True):
            if fs.get_file_info(f"{root}/{old}").type == FileType.File:
                fs.move(f"{root}/{old}", f"{root}/{new}")
            elif fs.get_file_info(f"{root}/{new}").type != FileType.File:
                raise FileNotFoundError(f"{folder}/{old}")
        yield batch[["name"]]


def committed(written: DataFrame, folder: str, **facts) -> list[dict]:
    """Run the writers (rows with ``temporary``, ``name`` and more), rename, write ``manifest.json``; its rows by name.

    The manifest has one row for each file, so it grows with bytes / file size.
    """
    manifest = stored(written, "manifest")
    moved = manifest.select("temporary", "name").mapInPandas(lambda it: _renamed(it, folder), "name string")
    moved.agg(F.count(F.lit(1))).first()
    rows = sorted((r.asDict() for r in manifest.collect()), key=lambda r: r["name"])
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/manifest.json.tmp") as out:
        out.write(json.dumps(facts | {"files": [{k: v for k, v in r.items() if k != "temporary"} for r in rows]}, default=str).encode())
    fs.move(f"{root}/manifest.json.tmp", f"{root}/manifest.json")
    fs.create_dir(f"{root}/_temporary", recursive=True)
    fs.delete_dir(f"{root}/_temporary")
    return rows


def listed(folder: str) -> dict:
    """The manifest of a complete folder."""
    fs, root = filesystem(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def file_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A row for each file, a task for each (up to 10,000 tasks)."""
    frame = spark.createDataFrame(rows, schema)
    return frame.repartition(min(max(len(rows), 1), 10_000))
