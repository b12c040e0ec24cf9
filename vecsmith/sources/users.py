"""Users and their keys as a small versioned table, and signed tokens."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import secrets
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecsmith.functions.secure import masked
from vecsmith.operators.collection import Store

USERS = "username string, api_key string, level int, created_at timestamp, updated_at timestamp"
PREFIX = "vdb_"


def new_key() -> str:
    return PREFIX + secrets.token_urlsafe(32)


def _b64(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def token(claims: dict, secret: str, seconds: int = 3600, now: float | None = None) -> str:
    """A signed web token (HMAC-SHA-256) that ends after ``seconds``."""
    body = claims | {"exp": int((time.time() if now is None else now) + seconds)}
    head = ".".join(_b64(json.dumps(x).encode()) for x in ({"alg": "HS256", "typ": "JWT"}, body))
    return f"{head}.{_b64(hmac.new(secret.encode(), head.encode(), hashlib.sha256).digest())}"


def claims(text: str, secret: str, now: float | None = None) -> dict | None:
    """The claims of a valid token, else None."""
    head, _, mark = text.rpartition(".")
    want = _b64(hmac.new(secret.encode(), head.encode(), hashlib.sha256).digest())
    if not hmac.compare_digest(mark, want):
        return None
    part = head.partition(".")[2]
    body = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    return body if body["exp"] > (time.time() if now is None else now) else None


class Users:
    """create, find, list (keys masked), set_level, delete, check."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    def rows(self) -> DataFrame:
        if not self.store.exists("current"):
            return self.spark.createDataFrame([], USERS)
        return self.spark.read.schema(USERS).parquet(f"{self.store.root}/{self.store.read('current')}")

    def _replace(self, rows: DataFrame) -> None:
        old = self.store.read("current") if self.store.exists("current") else None
        new = f"users-{secrets.token_hex(8)}"
        rows.coalesce(1).write.parquet(f"{self.store.root}/{new}")
        self.store.write("current", new)
        if old:
            self.store.delete(old)

    def create(self, username: str, level: int = 0) -> str | None:
        """The new key; None if the user exists."""
        if self.find(username).limit(1).count():
            return None
        key = new_key()
        one = self.spark.range(1).select(F.lit(username).alias("username"), F.lit(key).alias("api_key"), F.lit(level).alias("level"), F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"))
        self._replace(self.rows().unionByName(one))
        return key

    def find(self, username: str) -> DataFrame:
        return self.rows().where(F.col("username") == username)

    def check(self, username: str, key: str) -> bool:
        return self.find(username).where(F.col("api_key") == key).limit(1).count() == 1

    def list(self) -> DataFrame:
        return self.rows().withColumn("api_key", masked(F.col("api_key")))

    def set_level(self, username: str, level: int) -> bool:
        if not self.find(username).limit(1).count():
            return False
        hit = F.col("username") == username
        self._replace(self.rows().withColumns({"level": F.when(hit, F.lit(level)).otherwise(F.col("level")), "updated_at": F.when(hit, F.current_timestamp()).otherwise(F.col("updated_at"))}))
        return True

    def delete(self, username: str) -> bool:
        if not self.find(username).limit(1).count():
            return False
        self._replace(self.rows().where(F.col("username") != username))
        return True
