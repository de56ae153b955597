"""What the corpus operators share: scratch tables, ports to Python workers, word features and online weights."""

from __future__ import annotations

import os
import re
import uuid
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Used only on one machine, where the session names no spark.checkpoint.dir, as in tests.
DEFAULT_SHARED = "/tmp/checkpoints/meshlore"

#: Python workers are kept from task to task and from operator to operator; by these what one task freed goes back to the machine.
LEAN = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(8 << 20), "MALLOC_TRIM_THRESHOLD_": str(32 << 20)}

WORD = re.compile(r"\w+")
WORD_OR_SIGN = re.compile(r"\w+|[^\w\s]+")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where they share the driver's file system (elsewhere use --py-files), and give memory back."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    for name, value in LEAN.items():
        env.setdefault(name, os.environ.get(name, value))
    have = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *have])


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as it takes to be no column of docs (in any case)."""
    have = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        out.append(name)
    return out


class Scratch:
    """Tables written under the shared checkpoint folder: they cut lineage and outlive lost executors.

    The folder goes when the driver's JVM ends, since results may be read until then; large tables that no result reads are dropped before.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = DEFAULT_SHARED
        self.root = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Delete a table that no plan reads any more; without a name, all of them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class WordIds(dict):
    """word -> 32-bit hash, the same in every process; emptied when it gets large, so memory stays bounded."""

    LIMIT = 150_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = found = xxhash.xxh32_intdigest(word)
        return found


def ngram_slots(ids: np.ndarray, bits: int, longest: int = 2) -> np.ndarray:
    """Slots of all n-grams of up to `longest` words in a table of 2**bits, repeats included."""
    mask, h, out = np.uint64((1 << bits) - 1), ids.astype(np.uint64), []
    run = h * np.uint64(0x9E3779B97F4A7C15)
    for n in range(1, longest + 1):
        if n > 1:
            if len(run) < 2:
                break
            run = (run[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (h[n - 1 :] * np.uint64(0x165667B19E3779F9))
        out.append(((run ^ (run >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(24)) & mask)
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


class Ftrl:
    """Follow-the-regularised-leader (proximal) weights; slot `size` is the intercept, which has no L1 penalty."""

    def __init__(self, size: int, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.size, self.alpha, self.beta, self.l1, self.l2 = size, alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        l1 = np.where((np.arange(self.size + 1) if isinstance(at, slice) else at) == self.size, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def update(self, at: np.ndarray, grad: np.ndarray, w: np.ndarray) -> None:
        """`at` without repeats; w are the weights there from which the gradient was taken."""
        n, square = self.n[at], grad * grad
        self.z[at] += grad - (np.sqrt(n + square) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + square


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))
