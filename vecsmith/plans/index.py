"""One interface over all index kinds: ``create_index(kind, dim).add(df).search(queries, k)``."""

from __future__ import annotations

from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecsmith.operators.graph import ProximityGraphs
from vecsmith.operators.ivf import InvertedCells
from vecsmith.operators.lsh import HashTables
from vecsmith.operators.pq import ProductQuantizer
from vecsmith.operators.scratch import stored
from vecsmith.operators.search import knn
from vecsmith.operators.trees import PlaneForest, PrunedCells

_POOL = ThreadPoolExecutor(4, thread_name_prefix="index")
KINDS = ("flat_l2", "flat_ip", "ivf", "pq", "lsh", "hnsw", "kdtree", "balltree", "annoy")


class Index:
    """Rows are (id, vector), numbered by the caller's ids. Added frames are kept as they are; ``build`` stores what searches need of them."""

    def __init__(self, kind: str, dim: int, **options):
        if kind not in KINDS:
            raise ValueError(f"unknown index {kind!r}; one of {KINDS}")
        if dim < 1:
            raise ValueError("the dimension must be at least 1")
        self.kind, self.dim = kind, dim
        self.rows: DataFrame | None = None
        self.state = None
        self.method = {
            "flat_l2": lambda **o: "l2", "flat_ip": lambda **o: "ip", "ivf": InvertedCells, "pq": ProductQuantizer, "lsh": lambda **o: HashTables(dim, **o), "hnsw": ProximityGraphs,
            "kdtree": lambda **o: PrunedCells("kd", **o), "balltree": lambda **o: PrunedCells("ball", **o), "annoy": PlaneForest,
        }[kind](**options)

    def _checked(self, df: DataFrame) -> DataFrame:
        other = df.where(F.size("embedding") != self.dim).limit(1).count()
        if other:
            raise ValueError(f"vectors must have dimension {self.dim}")
        return df

    def train(self, df: DataFrame) -> Index:
        """Fit cells or codebooks; the other kinds need none."""
        if self.kind in ("ivf", "pq"):
            self.method.fit(self._checked(df))
        return self

    def add(self, df: DataFrame) -> Index:
        """Rows with columns vec_id and embedding."""
        df = self._checked(df).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
        self.rows = df if self.rows is None else self.rows.unionByName(df)
        self.state = None
        return self

    def build(self) -> Index:
        """Make and store what searches need: cells, codes, assigned leaves or graphs; ``search`` does so by itself."""
        if self.rows is None:
            raise RuntimeError("the index is empty")
        if self.kind == "ivf":
            self.state = self.method.assign(self.rows)
        elif self.kind == "pq":
            self.state = self.method.encode(self.rows)
        elif self.kind == "lsh":
            self.state = self.method.encode(self.rows)
        elif self.kind in ("kdtree", "balltree", "annoy"):
            self.state = self.method.fit(self.rows)
        elif self.kind == "hnsw":
            self.state = self.method.fit(self.rows)
        if isinstance(self.state, DataFrame):
            self.state = stored(self.state, self.kind)
        return self

    def set_nprobe(self, nprobe: int) -> None:
        if self.kind != "ivf":
            raise TypeError(f"{self.kind} has no nprobe")
        self.method.set_nprobe(nprobe)

    def set_ef_search(self, width: int) -> None:
        if self.kind != "hnsw":
            raise TypeError(f"{self.kind} has no search width")
        self.method.set_width(width)

    def train_async(self, df: DataFrame) -> Future:
        return _POOL.submit(self.train, df)

    def add_async(self, df: DataFrame) -> Future:
        return _POOL.submit(self.add, df)

    def search_async(self, queries: DataFrame, k: int = 10, **options) -> Future:
        """The rows found, worked out in a thread of the driver (and so beside other jobs) when the future is done."""
        return _POOL.submit(lambda: stored(self.search(queries, k, **options), "found"))

    @property
    def size(self) -> int:
        return 0 if self.rows is None else self.rows.count()

    def search(self, queries: DataFrame, k: int = 10, **options) -> DataFrame:
        """(query_id, rank, vec_id, score)."""
        if k < 1:
            raise ValueError("k must be at least 1")
        if self.rows is None:
            raise RuntimeError("the index is empty")
        queries = self._checked(queries)
        if self.kind.startswith("flat"):
            return knn(self.rows, queries, k, self.method)
        if self.state is None:
            self.build()
        if self.kind == "lsh":
            return self.method.search(self.state, self.method.encode(queries), k, **options)
        if self.kind in ("kdtree", "balltree", "annoy", "hnsw"):
            return self.method.search(queries, k, **options)
        return self.method.search(self.state, queries, k, **options)


def create_index(kind: str, dim: int, **options) -> Index:
    return Index(kind, dim, **options)
