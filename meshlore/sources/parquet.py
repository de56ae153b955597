"""Versioned Parquet stores, retries, dumps, corpus and question readers, manifests, the working folder."""

from __future__ import annotations

import functools
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_SHARED = "/tmp/checkpoints/meshlore"


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (base or DEFAULT_SHARED).rstrip("/")


def hadoop(spark: SparkSession, path: str):
    """(path, file system) of the JVM."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def retried(trials: int = 5, wait: float = 10.0, errors: tuple = (ConnectionError, TimeoutError), again: Callable | None = None):
    """Decorator: on one of `errors` call again(*args) where given, sleep and try anew, `trials` times in all; the last error is raised."""

    def add(f):
        @functools.wraps(f)
        def call(*args, **kwargs):
            for left in range(trials - 1, -1, -1):
                try:
                    return f(*args, **kwargs)
                except errors:
                    if not left:
                        raise
                    time.sleep(wait)
                    if again:
                        again(*args)

        return call

    return add


class Workspace:
    """Tables under the shared checkpoint folder; saving one cuts lineage and survives lost executors. The folder goes when the driver's JVM ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        path, files = hadoop(spark, self.root)
        files.mkdirs(path)
        files.deleteOnExit(path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


class Store:
    """A named Parquet table with create, read, upsert, update, delete, count, exist and clear; every change writes a new version, then a commit that names it.

    Commits are numbered and appear whole, by a rename. Readers of an old version are not disturbed, a failed write leaves the old one in place, and of two writers that
    start from one version the second fails.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, key: str):
        self.spark, self.path, self.key, self.opened = spark, f"{root}/{name}", key, True

    def __enter__(self) -> Store:
        return self.open()

    def __exit__(self, *_) -> None:
        self.close()

    def open(self) -> Store:
        self.opened = True
        return self

    def close(self) -> None:
        self.opened = False

    def is_open(self) -> bool:
        return self.opened

    def _commits(self) -> list[str]:
        if not self.opened:
            raise ValueError(f"{self.path} is closed")
        path, files = hadoop(self.spark, f"{self.path}/commits")
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def version(self) -> str | None:
        done = [c for c in self._commits() if not c.startswith("_")]
        return done[-1].split("-", 1)[1] if done else None

    def read(self) -> DataFrame:
        v = self.version()
        if v is None:
            raise ValueError(f"{self.path} is empty")
        return self.spark.read.parquet(f"{self.path}/{v}")

    def _old(self) -> tuple[int, DataFrame | None]:
        done = [c for c in self._commits() if not c.startswith("_")]
        return (int(done[-1].split("-")[0]), self.read()) if done else (0, None)

    def _commit(self, df: DataFrame, after: int) -> None:
        v = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/{v}")
        aside, files = hadoop(self.spark, f"{self.path}/commits/_{v}")
        files.create(aside, False).close()
        if any(c.startswith(f"{after + 1:08d}-") for c in self._commits()) or not files.rename(aside, hadoop(self.spark, f"{self.path}/commits/{after + 1:08d}-{v}")[0]):
            files.delete(aside, False)
            raise RuntimeError(f"{self.path} was changed by another writer")

    def _checked(self, new: DataFrame, unique: bool = True) -> DataFrame:
        """Null keys raise; of rows with one key, all raise if keys must be unique, else one is taken."""
        n, known, distinct = new.agg(F.count("*"), F.count(self.key), F.count_distinct(self.key)).first()
        if known < n:
            raise ValueError("a key is null")
        if unique and distinct < n:
            raise ValueError("a key comes twice")
        return new

    def create(self, new: DataFrame) -> None:
        """Unknown keys are added, known ones skipped; null keys raise, and of a batch's equal keys one row is taken."""
        after, old = self._old()
        new = self._checked(new, False).dropDuplicates([self.key])
        self._commit(new if old is None else old.unionByName(new.join(old.select(self.key), self.key, "left_anti")), after)

    def upsert(self, new: DataFrame) -> None:
        """Null and repeated keys raise."""
        after, old = self._old()
        new = self._checked(new)
        self._commit(new if old is None else old.join(new.select(self.key), self.key, "left_anti").unionByName(new), after)

    def update(self, new: DataFrame) -> None:
        """Known keys get the new rows; unknown ones are ignored."""
        after, old = self._old()
        if old is not None:
            known = self._checked(new).join(old.select(self.key), self.key, "left_semi").select(*old.columns)
            self._commit(old.join(known.select(self.key), self.key, "left_anti").unionByName(known), after)

    def delete(self, keys: DataFrame) -> None:
        """Unknown keys are ignored."""
        after, old = self._old()
        if old is not None:
            self._commit(old.join(keys.select(self.key), self.key, "left_anti"), after)

    def read_ids(self, keys: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """The rows of these keys; of the given columns and the key alone, if any are given."""
        found = self.read().join(keys.select(self.key).distinct(), self.key, "left_semi")
        return found.select(self.key, *[c for c in columns if c != self.key]) if columns is not None else found

    def exist(self, keys: DataFrame) -> DataFrame:
        """(key, found)."""
        have = self.read().select(self.key, F.lit(True).alias("found")) if self.version() else keys.select(self.key).limit(0).withColumn("found", F.lit(True))
        return keys.select(self.key).distinct().join(have, self.key, "left").select(self.key, F.coalesce("found", F.lit(False)).alias("found"))

    def count(self) -> int:
        return 0 if self.version() is None else self.read().count()

    def clear(self) -> None:
        path, files = hadoop(self.spark, self.path)
        files.delete(path, True)


def stores_under(spark: SparkSession, root: str) -> list[str]:
    """Paths from root of all stores below it, in order; '' is root itself."""
    path, files = hadoop(spark, root)
    if not files.exists(path):
        return []
    below = sorted(s.getPath().getName() for s in files.listStatus(path) if s.isDirectory())
    if "commits" in below:
        return [""]
    return [f"{p}/{s}".rstrip("/") for p in below for s in stores_under(spark, f"{root}/{p}")]


def _store_at(spark: SparkSession, root: str, name: str) -> Store:
    return Store(spark, *f"{root}/{name}".rstrip("/").rsplit("/", 1), "")


def store_sizes(spark: SparkSession, root: str) -> dict[str, int]:
    """Rows of every store below root, by its path from there: what caches and statistics hold, stage by stage."""
    return {p: _store_at(spark, root, p).count() for p in stores_under(spark, root)}


def clear_stores(spark: SparkSession, root: str) -> None:
    for p in stores_under(spark, root):
        _store_at(spark, root, p).clear()


def dump(df: DataFrame, root: str, name: str, rewrite: bool = True) -> str:
    """Write a table under root; an existing one is replaced, or, if not to be rewritten, stays beside the new one, whose name gets a suffix. Returns the path."""
    path, files = hadoop(df.sparkSession, f"{root}/{name}")
    if files.exists(path) and not rewrite:
        name = f"{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(f"{root}/{name}")
    return f"{root}/{name}"


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of a database server by JDBC; its driver must be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


#: Graph, vector, key-value, table and tree back ends by name. All that are here are Parquet stores; others are read or written by a Spark connector of the given format.
FORMATS = {
    "parquet": "parquet", "inmemory_graph": "parquet", "inmemory": "parquet", "inmemory_kv": "parquet", "inmemory_table": "parquet", "mixed_kv": "parquet", "neo4j": "org.neo4j.spark.DataSource", "mongo": "mongodb", "redis": "org.apache.spark.sql.redis",
    "elasticsearch": "org.elasticsearch.spark.sql", "opensearch": "org.opensearch.spark.sql", "qdrant": "io.qdrant.spark.Qdrant", "postgresql": "jdbc", "mysql": "jdbc", "sqlite3": "jdbc",
}


def source(spark: SparkSession, vendor: str, options: dict[str, str]) -> DataFrame:
    """A table of another store through its Spark connector (not shipped here); an unknown vendor raises."""
    if vendor not in FORMATS:
        raise ValueError(f"no back end {vendor!r}; known are {', '.join(sorted(FORMATS))}")
    return spark.read.format(FORMATS[vendor]).options(**options).load()


def sink(df: DataFrame, vendor: str, options: dict[str, str], mode: str = "append") -> None:
    if vendor not in FORMATS:
        raise ValueError(f"no back end {vendor!r}; known are {', '.join(sorted(FORMATS))}")
    df.write.format(FORMATS[vendor]).options(**options).mode(mode).save()


def contexts_csv(spark: SparkSession, path: str) -> DataFrame:
    """(title, context, cntx_idx, hash, text): text is the title, a line end and the context."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.withColumn("text", F.concat_ws("\n", F.concat(F.lit("Title: "), "title"), "context"))


def qa_csv(spark: SparkSession, path: str) -> DataFrame:
    """Question pairs; cntx_ids is a literal list of whole numbers."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.withColumn("cntx_ids", F.from_json("cntx_ids", "array<int>"))


def dialogs_json(spark: SparkSession, path: str) -> DataFrame:
    """(text, time) of {data: [{text_dialog, time}]}."""
    df = spark.read.schema("data array<struct<text_dialog:string,time:string>>").json(path, multiLine=True)
    return df.select(F.explode("data").alias("d")).select(F.col("d.text_dialog").alias("text"), "d.time")


def save_manifest(spark: SparkSession, root: str, about: dict) -> None:
    spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/_manifest")


def load_manifest(spark: SparkSession, root: str) -> dict:
    return json.loads(spark.read.text(f"{root}/_manifest").first().value)


#: Tables of an environment.
LAYOUT = ("nodes", "triplets", "vectors", "postings", "tree", "kv", "provenance", "statistics")


def create_environment(spark: SparkSession, root: str, name: str, config: dict) -> str:
    """A folder with a sub-folder for each table and a manifest of its configuration; an existing one raises."""
    base = f"{root}/{name}"
    path, files = hadoop(spark, base)
    if files.exists(path):
        raise ValueError(f"{base} exists")
    for part in LAYOUT:
        files.mkdirs(hadoop(spark, f"{base}/{part}")[0])
    save_manifest(spark, base, config)
    return base


def find_environments(spark: SparkSession, root: str) -> list[str]:
    """Names of the valid environments under root, in order."""
    path, files = hadoop(spark, root)
    names = [s.getPath().getName() for s in files.listStatus(path) if s.isDirectory()] if files.exists(path) else []
    return sorted(n for n in names if not missing_parts(spark, f"{root}/{n}"))


def missing_parts(spark: SparkSession, base: str) -> list[str]:
    """What an environment lacks: nothing, if it is valid."""
    return [p for p in (*LAYOUT, "_manifest") if not hadoop(spark, base)[1].exists(hadoop(spark, f"{base}/{p}")[0])]


def load_environment(spark: SparkSession, base: str) -> dict:
    if gone := missing_parts(spark, base):
        raise ValueError(f"{base} lacks {', '.join(gone)}")
    return load_manifest(spark, base)
