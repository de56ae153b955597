"""Stored indexes: vectors with checks, postings in segments, and several indexes over one set of items."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlore.operators import retrieval
from meshlore.sources.parquet import Store, hadoop

#: Columns that a read may ask for (fixed values).
INCLUDES = ("documents", "metadatas", "embeddings")


def check_retrieval(k: int, includes: list[str] | None = None, queries: DataFrame | None = None, subset: DataFrame | None = None) -> None:
    """ValueError unless k is a whole number, includes are known names, queries have (query_id, q or text) and a subset (query_id, id)."""
    if isinstance(k, bool) or not isinstance(k, int):
        raise ValueError("the number of results must be a whole number")
    if any(i not in INCLUDES for i in includes or []):
        raise ValueError(f"includes must be among {INCLUDES}")
    if queries is not None and not ("query_id" in queries.columns and {"q", "text"} & set(queries.columns)):
        raise ValueError("queries need query_id and q or text")
    if subset is not None and not {"query_id", "id"} <= set(subset.columns):
        raise ValueError("a subset needs query_id and id")


class VectorIndex:
    """Items (id, document, embedding, metadata map<string,string>) in one store. With an embedder items come without embeddings, else with them."""

    def __init__(self, spark: SparkSession, root: str, name: str = "vectors", embed=None):
        self.store, self.embed = Store(spark, root, name, "id"), embed

    def _ready(self, new: DataFrame) -> DataFrame:
        if dict(new.dtypes).get("id") != "string":
            raise ValueError("ids must be strings")
        if (self.embed is None) != ("embedding" in new.columns):
            raise ValueError("an embedding is needed" if self.embed is None else "embeddings are made here")
        if "metadata" in new.columns and not new.filter(F.exists(F.map_values("metadata"), lambda x: x.isNull())).isEmpty():
            raise ValueError("metadata has a missing value")
        return new if self.embed is None else new.withColumn("embedding", self.embed(F.col("document")))

    def create(self, new: DataFrame) -> None:
        """Known ids are skipped; a batch's ids must differ."""
        self.store.create(self.store._checked(self._ready(new)))

    def upsert(self, new: DataFrame) -> None:
        self.store.upsert(self._ready(new))

    def delete(self, ids: DataFrame) -> None:
        self.store.delete(ids)

    @staticmethod
    def project(rows: DataFrame, columns: list[str]) -> DataFrame:
        return rows.select("id", *columns)

    def read(self, ids: DataFrame, includes: list[str]) -> DataFrame:
        check_retrieval(1, includes)
        return self.project(self.store.read_ids(ids), [i[:-1] for i in includes])

    def retrieve(self, queries: DataFrame, k: int = 50, subset: DataFrame | None = None) -> DataFrame:
        """(query_id, id, score, rank); an empty subset or k under 1 gives nothing."""
        check_retrieval(k, None, queries, subset)
        return retrieval.dense_topk(self.store.read().select("id", "embedding"), queries, k, subset)

    def count(self) -> int:
        return self.store.count()

    def exist(self, ids: DataFrame) -> DataFrame:
        return self.store.exist(ids)

    def clear(self) -> None:
        self.store.clear()


class LexicalIndex:
    """Texts (id, text) with their postings. Postings are written once for each change, as a segment sorted by term; the store of texts says which segment of an id counts."""

    def __init__(self, spark: SparkSession, root: str, name: str = "texts"):
        self.spark, self.segments, self.store = spark, f"{root}/{name}-postings", Store(spark, root, name, "id")

    def _add(self, new: DataFrame, replace: bool) -> None:
        if "embedding" in new.columns:
            raise ValueError("texts have no embeddings")
        segment = uuid.uuid4().hex
        new = self.store._checked(new.select("id", "text"))
        if not replace and self.store.version() is not None:
            new = new.join(self.store.read().select("id"), "id", "left_anti")
        rows = new.select("id", "text", F.size(retrieval.words("text")).alias("len"), F.lit(segment).alias("segment"))
        retrieval.postings(rows.select("id", "text")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{self.segments}/segment={segment}")
        self.store.upsert(rows)

    def create(self, new: DataFrame) -> None:
        """Known ids are skipped."""
        self._add(new, False)

    def upsert(self, new: DataFrame) -> None:
        self._add(new, True)

    def delete(self, ids: DataFrame) -> None:
        self.store.delete(ids)

    def read(self, ids: DataFrame) -> DataFrame:
        return self.store.read_ids(ids, ["text"])

    def retrieve(self, queries: DataFrame, k: int, subset: DataFrame | None = None, scale: bool = False) -> DataFrame:
        """(query_id, id, score, rank): BM25 over the live postings of the queries' terms."""
        check_retrieval(k, None, queries, subset)
        live = self.store.read()
        asked = retrieval.asked_terms(queries)
        index = self.spark.read.parquet(self.segments).join(asked.select("term").distinct(), "term", "left_semi").join(live.select("id", "segment"), ["id", "segment"], "left_semi").select("term", "id", "tf", "len")
        return retrieval.bm25_scores(index, live.agg(F.count("*").alias("n"), F.sum("len").alias("all_len")), asked, k, subset, scale)

    def count(self) -> int:
        return self.store.count()

    def exist(self, ids: DataFrame) -> DataFrame:
        return self.store.exist(ids.select("id"))

    def clear(self) -> None:
        self.store.clear()
        path, files = hadoop(self.spark, self.segments)
        files.delete(path, True)


class Composer:
    """Indexes over the same items: changes go to all, reads to the first or a named one, an item is there if all have it."""

    def __init__(self, members: dict):
        if not members:
            raise ValueError("an index is needed")
        self.members = members

    def create(self, new: DataFrame) -> None:
        for m in self.members.values():
            m.create(new)

    def upsert(self, new: DataFrame) -> None:
        for m in self.members.values():
            m.upsert(new)

    def delete(self, ids: DataFrame) -> None:
        for m in self.members.values():
            m.delete(ids)

    def read(self, name: str | None = None, *args) -> DataFrame:
        return (self.members[name] if name else next(iter(self.members.values()))).read(*args)

    def exist(self, ids: DataFrame) -> DataFrame:
        """(id, found)."""
        each = None
        for m in self.members.values():
            each = m.exist(ids) if each is None else each.union(m.exist(ids))
        return each.groupBy("id").agg(F.every("found").alias("found"))

    def counts(self) -> dict[str, int]:
        """Equal for all members, or the indexes have come apart."""
        return {n: m.count() for n, m in self.members.items()}

    def clear(self) -> None:
        for m in self.members.values():
            m.clear()
