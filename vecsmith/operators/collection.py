"""Collections of vectors: versioned tables with numbered manifests, changed by copy and swap.

``root/<collection>/manifest-<version>.json`` names a version's parts; the newest one
counts. A write makes new Parquet parts and then a new manifest under a name that nobody
had, so readers see whole versions and a crash in between leaves the last one. What a
version replaces goes when the next but one is written. Appends add a part;
changes and deletes write a compacted one. All goes through Hadoop's file system, so any store will do.

Writers of one collection wait for each other: threads by a lock, processes by a file
that only one of them can create.
"""

from __future__ import annotations

import contextlib
import json
import re
import threading
import time
import uuid

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecsmith.functions.distance import metric as metric_of
from vecsmith.operators.filters import map_equals
from vecsmith.operators.search import dimension_checked, knn, top_k

_SCHEMA = "vec_id string, seq long, vector array<float>, metadata map<string,string>"
_COLUMNS = ("vec_id", "seq", "vector", "metadata")
_LOCKS: dict[str, threading.Lock] = {}
_MANIFEST = re.compile(r"manifest-(\d{12})\.json")
#: Seconds after which a lock file counts as left behind by a writer that died, and that a writer waits at most.
STALE, PATIENCE = 3600.0, 600.0
INDEXES = ("flat", "ivf", "hnsw", "annoy")


class Store:
    """Small files through Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def fs(self, name: str = ""):
        return self.path(name or ".").getFileSystem(self.conf)

    def exists(self, name: str) -> bool:
        return self.fs(name).exists(self.path(name))

    def read(self, name: str) -> str:
        stream = self.fs(name).open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Written beside, then renamed over."""
        beside = f"{name}.{uuid.uuid4().hex}"
        out = self.fs(name).create(self.path(beside), True)
        out.write(bytearray(text.encode()))
        out.close()
        if self.exists(name):
            self.delete(name)
        if not self.fs(name).rename(self.path(beside), self.path(name)):
            raise OSError(f"could not replace {name}")

    def claim(self, name: str) -> bool:
        """Create an empty file; False if it is there. A claim older than ``STALE`` seconds is taken away first."""
        fs, path = self.fs(name), self.path(name)
        try:
            if fs.exists(path) and time.time() - fs.getFileStatus(path).getModificationTime() / 1000 > STALE:
                fs.delete(path, False)
            fs.create(path, False).close()
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e) or "FileNotFound" in str(e):
                return False
            raise
        return True

    def delete(self, name: str) -> bool:
        return self.fs(name).delete(self.path(name), True)

    def list(self, name: str = "") -> list[tuple[str, int]]:
        """(name, modification time in ms) of what lies in a folder."""
        if not self.exists(name or "."):
            return []
        return [(s.getPath().getName(), s.getModificationTime()) for s in self.fs(name).listStatus(self.path(name or "."))]

    def copy(self, source: str, target: str) -> None:
        fs = self.fs(source)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(fs, self.path(source), fs, self.path(target), False, self.conf)

    def move(self, source: str, target: str) -> None:
        if not self.fs(source).rename(self.path(source), self.path(target)):
            raise OSError(f"could not move {source}")


class Collections:
    """create, insert, search, modify, merge, delete, drop, rebuild, optimize, count."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    def _versions(self, name: str) -> list[int]:
        return sorted(int(m[1]) for n, _ in self.store.list(name) if (m := _MANIFEST.fullmatch(n)))

    def _manifest(self, name: str) -> dict:
        found = self._versions(name)
        if not found:
            raise KeyError(f"no collection {name!r}")
        try:
            return json.loads(self.store.read(f"{name}/manifest-{found[-1]:012d}.json"))
        except Py4JJavaError:  # replaced twice meanwhile
            return json.loads(self.store.read(f"{name}/manifest-{self._versions(name)[-1]:012d}.json"))

    def _save(self, name: str, manifest: dict, replaced: list[str] = ()) -> None:
        """The next version; what the last one replaced goes now, what this one replaces (``replaced``) with the next."""
        version = manifest["version"] + 1
        self.store.write(f"{name}/manifest-{version:012d}.json", json.dumps(manifest | {"version": version, "replaced": [*replaced]}))
        for gone in manifest.get("replaced", []):
            self.store.delete(f"{name}/{gone}")
        for old in self._versions(name):
            if old < version - 1:
                self.store.delete(f"{name}/manifest-{old:012d}.json")

    @contextlib.contextmanager
    def _lock(self, name: str):
        with _LOCKS.setdefault(f"{self.store.root}/{name}", threading.Lock()):
            claim, until = f"_locks/{name}", time.time() + PATIENCE
            while not self.store.claim(claim):
                if time.time() > until:
                    raise TimeoutError(f"another writer holds collection {name!r}")
                time.sleep(0.05)
            try:
                yield
            finally:
                self.store.delete(claim)

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def names(self) -> list[str]:
        return sorted(n for n, _ in self.store.list() if not n.startswith("_") and self.exists(n))

    def create(self, name: str, dimension: int, metric: str = "l2") -> bool:
        """False if it exists."""
        metric_of(metric)
        if dimension < 1:
            raise ValueError("the dimension must be at least 1")
        with self._lock(name):
            if self.exists(name):
                return False
            self._save(name, {"version": 0, "dimension": dimension, "metric": metric, "next": 0, "parts": [], "index": "flat"})
            return True

    def _read(self, name: str, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], _SCHEMA)
        read = [self.spark.read.schema(_SCHEMA).parquet(f"{self.store.root}/{name}/{p}").select(*_COLUMNS) for p in parts]
        out = read[0]
        for r in read[1:]:
            out = out.unionByName(r)
        return out

    def rows(self, name: str) -> DataFrame:
        """(vec_id, seq, vector, metadata) of the current version, in no order."""
        return self._read(name, self._manifest(name)["parts"])

    def _cells(self, m: dict):
        from vecsmith.operators.ivf import InvertedCells

        return InvertedCells(nprobe=m["nprobe"], centroids=np.array(m["centroids"]), metric=m["metric"])

    def _write(self, name: str, rows: DataFrame, m: dict, batch_size: int | None = None) -> str:
        """A new part; in a collection with inverted cells, with a folder for each cell."""
        part, rows = f"part-{uuid.uuid4().hex}", rows.select(*_COLUMNS)
        if m["index"] == "ivf":
            # large cells are split over tasks, small ones share one
            rows = self._cells(m).placed(rows, "vector").hint("rebalance", F.col("list_id"))
        writer = rows.write
        if batch_size:
            writer = writer.option("maxRecordsPerFile", batch_size)
        (writer.partitionBy("list_id") if m["index"] == "ivf" else writer).parquet(f"{self.store.root}/{name}/{part}")
        return part

    def insert(self, name: str, rows: DataFrame, vector: str = "vector", metadata: str | None = "metadata", batch_size: int | None = None) -> DataFrame:
        """Append rows under new ids; (vec_id, seq) of these. ``seq`` goes on from the last one."""
        with self._lock(name):
            m = self._manifest(name)
            given = rows.select(dimension_checked(F.col(vector).cast("array<float>"), m["dimension"]).alias("vector"), (F.col(metadata) if metadata in rows.columns else F.lit(None)).cast("map<string,string>").alias("metadata"))
            # ids and numbers within tasks, stored once; then numbers go on from task to task
            part = self._write(name, given.select(F.uuid().alias("vec_id"), F.monotonically_increasing_id().alias("seq"), "vector", "metadata"), m | {"index": "flat"}, batch_size)
            raw = self.spark.read.schema(_SCHEMA).parquet(f"{self.store.root}/{name}/{part}")
            task = F.shiftright("seq", 33)
            counts = sorted((r[0], r[1]) for r in raw.groupBy(task.alias("t")).count().collect())  # one row for each task
            base, at = {}, m["next"]
            for t, n in counts:
                base[t], at = at, at + n
            if not counts:
                self.store.delete(f"{name}/{part}")
                return self.spark.createDataFrame([], "vec_id string, seq long")
            first = self.spark.createDataFrame(list(base.items()), "t long, base long")
            numbered = raw.withColumn("t", task).join(first, "t").withColumn("seq", F.col("base") + F.col("seq").bitwiseAND(F.lit((1 << 33) - 1)))
            final = self._write(name, numbered, m, batch_size)
            self.store.delete(f"{name}/{part}")
            self._save(name, m | {"parts": [*m["parts"], final], "next": at})
            return self._read(name, [final]).select("vec_id", "seq")

    def _replace(self, name: str, m: dict, rows: DataFrame) -> None:
        """One part instead of all; stored graphs or trees go, as they speak of other rows."""
        gone = [*m["parts"], *([m["built"]] if m.get("built") else [])]
        if m["index"] in ("hnsw", "annoy"):
            m = m | {"index": "flat", "built": None, "covers": []}
        self._save(name, m | {"parts": [self._write(name, rows, m)]}, gone)

    def modify(self, name: str, changes: DataFrame, merge: bool = False) -> bool:
        """Replace vector and metadata of the rows in ``changes`` (vec_id, vector, metadata); whether any was there.

        Places stay. With ``merge`` null vectors keep the old one and metadata entries are added to the old ones.
        A change that comes twice for one id is an error.
        """
        with self._lock(name):
            m, rows = self._manifest(name), self.rows(name)
            if changes.groupBy("vec_id").count().where("count > 1 and vec_id is not null").limit(1).count():
                raise ValueError("several changes for one vec_id")
            new = changes.select("vec_id", F.col("vector").cast("array<float>").alias("_v"), F.col("metadata").cast("map<string,string>").alias("_m"), F.lit(True).alias("_hit"))
            both = rows.join(new, "vec_id", "left")
            if both.where("_hit").limit(1).count() == 0:
                return False
            old_kept = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(F.coalesce("_m", F.create_map().cast("map<string,string>")), k))
            merged = F.map_concat(old_kept, F.coalesce("_m", F.create_map().cast("map<string,string>")))
            vector = F.coalesce("_v", "vector") if merge else F.when(F.col("_hit"), F.col("_v")).otherwise(F.col("vector"))
            metadata = F.when(F.col("_hit"), merged if merge else F.col("_m")).otherwise(F.col("metadata"))
            checked = F.when(F.col("_hit"), dimension_checked(vector, m["dimension"])).otherwise(F.col("vector"))
            self._replace(name, m, both.select("vec_id", "seq", checked.alias("vector"), metadata.alias("metadata")))
            return True

    def delete(self, name: str, ids: list[str] | DataFrame) -> bool:
        """Whether any of the ids was there."""
        with self._lock(name):
            m, rows = self._manifest(name), self.rows(name)
            gone = ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "vec_id string")
            if rows.join(gone, "vec_id", "left_semi").limit(1).count() == 0:
                return False
            self._replace(name, m, rows.join(gone, "vec_id", "left_anti"))
            return True

    def drop(self, name: str) -> bool:
        """False if absent."""
        with self._lock(name):
            return self.exists(name) and self.store.delete(name)

    def get(self, name: str, vec_id: str) -> DataFrame:
        return self.rows(name).where(F.col("vec_id") == vec_id)

    def count(self, name: str) -> int:
        return self.rows(name).count()

    def dimension(self, name: str) -> int:
        return self._manifest(name)["dimension"]

    def rebuild(self, name: str) -> None:
        """Compact all parts into one in insertion order, and go back to exact search; rows without a vector go."""
        with self._lock(name):
            m = self._manifest(name)
            self._replace(name, m | {"index": "flat", "centroids": None}, self.rows(name).where("vector is not null").repartitionByRange("seq").sortWithinPartitions("seq"))

    def optimize(self, name: str, nlist: int = 100, nprobe: int = 1) -> int:
        """Search by inverted cells from now on, under the collection's metric; the number of cells, at most that of the rows.

        All rows are written by cell, so that a search reads the cells that its queries probe.
        """
        from vecsmith.operators.ivf import InvertedCells

        with self._lock(name):
            m, rows = self._manifest(name), self.rows(name)
            cells = max(1, min(nlist, rows.where("vector is not null").select("vector").distinct().limit(nlist).count()))
            index = InvertedCells(cells, nprobe, metric=m["metric"]).fit(rows, "seq", "vector")
            self._replace(name, m | {"index": "ivf", "nprobe": nprobe, "centroids": index.centroids.tolist()}, rows)
            return cells

    def build(self, name: str, kind: str, **options) -> None:
        """Search by stored proximity graphs (``hnsw``), plane trees (``annoy``), cells (``ivf``) or exactly (``flat``).

        Graphs and trees rank by squared L2, so the collection's metric must be that (or for trees ``angular``). Rows inserted
        later are searched exactly beside them; a change or delete ends them.
        """
        if kind not in INDEXES:
            raise ValueError(f"unknown index {kind!r}; one of {INDEXES}")
        if kind == "ivf":
            self.optimize(name, **options)
        elif kind == "flat":
            self.rebuild(name)
        else:
            with self._lock(name):
                m = self._manifest(name)
                if m["metric"] not in (("l2",) if kind == "hnsw" else ("l2", "angular")):
                    raise ValueError(f"{kind} does not rank by {m['metric']}")
                built = f"index-{uuid.uuid4().hex}"
                self._method(m["metric"], kind, options).fit(self.rows(name).where("vector is not null"), "seq", "vector").save(self.spark, f"{self.store.root}/{name}/{built}")
                self._save(name, m | {"index": kind, "options": options, "built": built, "covers": m["parts"]}, [m["built"]] if m.get("built") else [])

    def _method(self, metric: str, kind: str, options: dict):
        from vecsmith.operators.graph import ProximityGraphs
        from vecsmith.operators.trees import PlaneForest

        return ProximityGraphs(**options) if kind == "hnsw" else PlaneForest(**options, metric=metric)

    def search(self, name: str, queries: DataFrame, k: int = 10, filters: dict | None = None, mode: str = "post", condition: Column | None = None) -> DataFrame:
        """(query_id, rank, vec_id, score, metadata) for ``queries`` (query_id, q), by the collection's metric.

        ``post`` ranks first and may return fewer than k rows; ``pre`` filters first (and is exact where graphs or trees are built).
        """
        m = self._manifest(name)
        rows = self._read(name, m["parts"]).where("vector is not null")
        keep = map_equals(F.col("metadata"), filters) if condition is None else condition
        asked = queries.select(F.col("query_id").cast("long").alias("seq"), F.col("q").cast("array<float>").alias("vector"))
        ascending = metric_of(m["metric"]).ascending
        if m["index"] == "ivf" and m["parts"]:
            paths = [self.spark.read.schema(f"{_SCHEMA}, list_id int").parquet(f"{self.store.root}/{name}/{p}") for p in m["parts"]]
            cells = paths[0]
            for p in paths[1:]:
                cells = cells.unionByName(p)
            cells = cells.where(keep) if mode == "pre" else cells
            found = self._cells(m).search(cells.where("vector is not null").select(F.col("seq").alias("vec_id"), "vector", "list_id"), asked, k, "seq", "vector", written=True)
        elif m["index"] in ("hnsw", "annoy") and mode != "pre":
            built = self._method(m["metric"], m["index"], m["options"]).load(self.spark, f"{self.store.root}/{name}/{m['built']}")
            newer = self._read(name, [p for p in m["parts"] if p not in m["covers"]]).where("vector is not null")
            both = built.search(asked, k, "seq", "vector").drop("rank").unionByName(knn(newer, asked, k, m["metric"], "seq", "vector").drop("rank"))
            found = top_k(both, k, ascending)
        else:
            found = knn(rows.where(keep) if mode == "pre" else rows, asked, k, m["metric"], "seq", "vector")
        out = found.withColumnRenamed("vec_id", "seq").join(rows.select("seq", "vec_id", "metadata"), "seq")
        return (out.where(keep) if mode == "post" else out).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "metadata")
