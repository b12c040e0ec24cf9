"""File and metadata stores, and snapshots of folders."""

from __future__ import annotations

import re
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecsmith.functions.text import extension
from vecsmith.operators.collection import Store
from vecsmith.operators.filters import equals, sql_equals

FILE_COLUMNS = (
    "file_id string, file_name string, file_type string, modality string, file_size long, collection_id string, hash string, storage_path string, content_length long, word_count long, "
    "width int, height int, fps double, total_frames long, duration double, sample_rate int, timestamp timestamp, extra map<string,string>"
)


class FileStore:
    """Raw files as ``<root>/<uuid>.<ext>`` in any Hadoop store (local, s3a, ...)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    def put(self, content: bytes, name: str) -> str:
        """The new file's name."""
        ext = name.rpartition(".")[2].lower() if "." in name else ""
        target = f"{uuid.uuid4().hex}{'.' + ext if ext else ''}"
        out = self.store.fs(target).create(self.store.path(target), False)
        out.write(bytearray(content))
        out.close()
        return target

    def get(self, name: str) -> bytes | None:
        if not self.store.exists(name):
            return None
        return bytes(self.spark.read.format("binaryFile").load(f"{self.store.root}/{name}").select("content").first()[0])

    def list(self) -> list[str]:
        return sorted(n for n, _ in self.store.list())

    def delete(self, name: str) -> bool:
        return self.store.delete(name)

    def rows(self) -> DataFrame:
        """(storage_path, file_type, content) of all files."""
        raw = self.spark.read.format("binaryFile").load(self.store.root)
        return raw.select(F.substring_index("path", "/", -1).alias("storage_path"), extension(F.col("path")).alias("file_type"), "content")


def jdbc_write(df: DataFrame, url: str, table: str, **options) -> None:
    """Append to a database table (files as BLOBs, or metadata)."""
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()


def jdbc_read(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


class JdbcTable:
    """Rows of a database table by one key column: put, get, update, delete, search; whole columns go through Spark, single rows through the driver's connection.

    Values are bound as parameters; names of columns must be plain words.
    """

    def __init__(self, spark: SparkSession, url: str, table: str, key: str, **options):
        self.spark, self.url, self.table, self.key, self.options = spark, url, _plain(table), _plain(key), options

    def rows(self) -> DataFrame:
        return jdbc_read(self.spark, self.url, self.table, **self.options)

    def put(self, df: DataFrame) -> None:
        """Append; a key that is there already is the database's error, if it has a constraint."""
        jdbc_write(df, self.url, self.table, **self.options)

    def get(self, key) -> DataFrame:
        return self.rows().where(F.col(self.key) == F.lit(key))

    def update(self, key, **values) -> bool:
        """Whether the key was there."""
        return bool(values) and self._execute(f"UPDATE {self.table} SET {', '.join(f'{_plain(c)} = ?' for c in values)} WHERE {self.key} = ?", [*values.values(), key]) > 0

    def delete(self, key) -> bool:
        return self._execute(f"DELETE FROM {self.table} WHERE {self.key} = ?", [key]) > 0

    def search(self, filters: dict | None = None, null_safe: bool = True) -> DataFrame:
        """Rows whose columns equal the filters; None finds nulls, or with ``null_safe=False`` nothing. The database filters."""
        rows = self.rows()
        for c, v in (filters or {}).items():
            rows = rows.where(F.col(c).isNull() if v is None and null_safe else F.col(c) == F.lit(v))
        return rows

    def _execute(self, sql: str, values: list) -> int:
        jvm, properties = self.spark._jvm, self.spark._jvm.java.util.Properties()
        for k in ("user", "password"):
            if k in self.options:
                properties.setProperty(k, str(self.options[k]))
        connection = jvm.java.sql.DriverManager.getConnection(self.url, properties)
        try:
            statement = connection.prepareStatement(sql)
            for i, v in enumerate(values, 1):
                statement.setObject(i, bytearray(v) if isinstance(v, bytes) else v)
            return statement.executeUpdate()
        finally:
            connection.close()


def _plain(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.]*", name):
        raise ValueError(f"no plain name: {name!r}")
    return name


class MetadataStore:
    """File metadata by ``file_id``: typed columns and an overflow map, in versioned Parquet."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    def rows(self) -> DataFrame:
        if not self.store.exists("current"):
            return self.spark.createDataFrame([], FILE_COLUMNS)
        return self.spark.read.schema(FILE_COLUMNS).parquet(f"{self.store.root}/{self.store.read('current')}")

    def _replace(self, rows: DataFrame) -> None:
        old = self.store.read("current") if self.store.exists("current") else None
        new = f"version-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.store.root}/{new}")
        self.store.write("current", new)
        if old:
            self.store.delete(old)

    def put(self, rows: DataFrame) -> None:
        """Add or replace; columns that are no typed ones go to ``extra``. Several rows for one ``file_id`` are an error."""
        if rows.where("file_id is not null").groupBy("file_id").count().where("count > 1").limit(1).count():
            raise ValueError("several rows for one file_id")
        typed = {c.split()[0]: c.split()[1] for c in FILE_COLUMNS.split(", ")}
        more = [c for c in rows.columns if c not in typed]
        extra = F.create_map(*[x for c in more for x in (F.lit(c), F.col(c).cast("string"))]).cast("map<string,string>") if more else F.lit(None).cast("map<string,string>")
        cols = [(F.col(c) if c in rows.columns else (extra if c == "extra" else F.lit(None))).cast(k).alias(c) for c, k in typed.items()]
        new = rows.select(*cols)
        self._replace(self.rows().join(new.select("file_id"), "file_id", "left_anti").select(*typed).unionByName(new))

    def get(self, file_id: str) -> DataFrame:
        return self.rows().where(F.col("file_id") == file_id)

    def update(self, file_id: str, **values) -> bool:
        """Merge values into one row; False if it is absent."""
        if not self.get(file_id).limit(1).count():
            return False
        hit = F.col("file_id") == file_id
        rows, known = self.rows(), {c.split()[0]: c.split()[1] for c in FILE_COLUMNS.split(", ")}
        out = rows.withColumns({c: F.when(hit, F.lit(v).cast(known[c])).otherwise(F.col(c)) for c, v in values.items() if c in known})
        more = {k: str(v) for k, v in values.items() if k not in known}
        if more:
            old = F.map_filter(F.coalesce("extra", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(list(more)))
            out = out.withColumn("extra", F.when(hit, F.map_concat(old, F.create_map(*[F.lit(x) for kv in more.items() for x in kv]))).otherwise(F.col("extra")))
        self._replace(out)
        return True

    def delete(self, file_id: str) -> bool:
        if not self.get(file_id).limit(1).count():
            return False
        self._replace(self.rows().where(F.col("file_id") != file_id))
        return True

    def search(self, filters: dict | None = None, null_safe: bool = True) -> DataFrame:
        """Rows whose columns equal the filters; with ``null_safe=False`` by SQL equality."""
        return self.rows().where(equals(filters) if null_safe else sql_equals(filters))


class Snapshots:
    """Copies of folders under ``<root>/backups``: create, list (newest first), restore, delete."""

    def __init__(self, spark: SparkSession, root: str, folders: tuple[str, ...]):
        self.store, self.folders = Store(spark, root), folders

    def create(self) -> str:
        name = f"snapshot-{time.strftime('%Y%m%d%H%M%S')}-{uuid.uuid4().hex[:6]}"
        for f in self.folders:
            if self.store.exists(f):
                self.store.copy(f, f"backups/{name}/{f}")
        self.store.write(f"backups/{name}/manifest.json", "{}")  # last: a snapshot without it is incomplete
        return name

    def every(self, seconds: float, most: int | None = None) -> threading.Event:
        """Take a snapshot again and again in a thread of the driver, until the event is set; keep the newest ``most``."""
        ended = threading.Event()

        def run():
            while not ended.wait(seconds):
                self.create()
                for name in self.list()[most:] if most else ():
                    self.delete(name)

        threading.Thread(target=run, daemon=True, name="snapshots").start()
        return ended

    def list(self) -> list[str]:
        found = [(ms, n) for n, ms in self.store.list("backups") if self.store.exists(f"backups/{n}/manifest.json")]
        return [n for _, n in sorted(found, reverse=True)]

    def restore(self, name: str) -> bool:
        """Current folders move aside, and the snapshot's take their place."""
        if not self.store.exists(f"backups/{name}/manifest.json"):
            return False
        for f in self.folders:
            if self.store.exists(f):
                self.store.move(f, f"{f}.before-{uuid.uuid4().hex[:6]}")
            if self.store.exists(f"backups/{name}/{f}"):
                self.store.copy(f"backups/{name}/{f}", f)
        return True

    def delete(self, name: str) -> bool:
        return self.store.exists(f"backups/{name}") and self.store.delete(f"backups/{name}")
