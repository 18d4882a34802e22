"""A store of processed documents, their entities and their chunks, as Parquet datasets under one folder.

Documents are dealt into BUCKETS by a hash of their ids. A change writes anew the buckets that it touches, and then a file that
names where each bucket of each dataset is: a version. Readers see one version, the old or the new one whole. Versions
are numbered, and a number can be taken once: of two writers at a time, the second finds its number taken and does its change
again on the other's version. Versions but the newest KEPT are removed, with the files that no other names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

LONGEST_TEXT = 100_000
BUCKETS, KEPT, ATTEMPTS = 64, 3, 20
TABLES = {
    "documents": (
        "document_id string, source_path string, file_type string, document_type string, confidence double, summary string, "
        "keywords array<string>, text string, created_at timestamp"
    ),
    "entities": (
        "document_id string, ord int, text string, entity_type string, start int, end int, confidence double, normalized string, role string"
    ),
    "chunks": "document_id string, page_num int, chunk_index int, text string, block_type string",
}

#: For each dataset, the folder that holds each bucket.
Version = dict[str, dict[str, str]]


def chunk_rows(blocks: DataFrame) -> DataFrame:
    """document_id, page_num, chunk_index, text, block_type: numbers begin anew on each page."""
    w = Window.partitionBy("document_id", "page_num").orderBy("block_idx")
    return blocks.select("document_id", "page_num", (F.row_number().over(w) - 1).alias("chunk_index"), "text", "block_type")


def _bucket(document_id: Column) -> Column:
    return (F.crc32(document_id.cast("binary")) % BUCKETS).cast("int")


class DocumentStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # --- versions ---------------------------------------------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _numbers(self) -> list[int]:
        fs, folder = self._fs(f"{self.folder}/versions")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def _read(self, number: int) -> Version:
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.folder}/versions/{number:012d}").collect()))

    def _newest(self) -> tuple[int, Version]:
        numbers = self._numbers()
        return (numbers[-1], self._read(numbers[-1])) if numbers else (-1, {name: {} for name in TABLES})

    def _claim(self, number: int, version: Version) -> bool:
        """Writes a version; whether its number was free."""
        fs, path = self._fs(f"{self.folder}/versions/{number:012d}")
        draft_fs, draft = self._fs(f"{self.folder}/drafts/{uuid.uuid4().hex}")
        stream = draft_fs.create(draft, False)
        stream.write(json.dumps(version).encode())
        stream.close()
        fs.mkdirs(path.getParent())
        if fs.exists(path) or not fs.rename(draft, path):
            draft_fs.delete(draft, False)
            return False
        return True

    def _forget(self, newest: int) -> None:
        """Removes versions that are too old, and the buckets that only they name."""
        old = [n for n in self._numbers() if n <= newest - KEPT]
        if not old:
            return
        used = {place for n in self._numbers() if n > newest - KEPT for places in self._read(n).values() for place in places.values()}
        unused = {place for n in old for places in self._read(n).values() for place in places.values()} - used
        for place in [*unused, *(f"{self.folder}/versions/{n:012d}" for n in old)]:
            fs, path = self._fs(place)
            fs.delete(path, True)

    def _table(self, name: str, version: Version, buckets: set[str] | None = None) -> DataFrame:
        places = [place for bucket, place in sorted(version[name].items()) if buckets is None or bucket in buckets]
        return self.spark.read.schema(TABLES[name]).parquet(*places) if places else self.spark.createDataFrame([], TABLES[name])

    def table(self, name: str) -> DataFrame:
        return self._table(name, self._newest()[1])

    def _change(self, buckets: set[str], rows: Callable[[str, DataFrame], DataFrame]) -> None:
        """A new version in which the buckets of each dataset hold rows(dataset's name, its old rows of these buckets)."""
        for _ in range(ATTEMPTS):
            number, version = self._newest()
            made: Version = {}
            for name in TABLES:
                place = f"{self.folder}/data/{name}-{uuid.uuid4().hex}"
                new = rows(name, self._table(name, version, buckets)).withColumn("bucket", _bucket(F.col("document_id")))
                # all rows of a bucket in one task: a bucket is one file
                new.repartition(max(1, min(len(buckets), BUCKETS)), "bucket").write.partitionBy("bucket").parquet(place)
                fs, folder = self._fs(place)
                written = {s.getPath().getName().removeprefix("bucket="): str(s.getPath()) for s in fs.listStatus(folder) if s.isDirectory()}
                made[name] = {**{b: p for b, p in version[name].items() if b not in buckets}, **written}
            if self._claim(number + 1, made):
                self._forget(number + 1)
                return
        raise RuntimeError(f"the store changed {ATTEMPTS} times while a change was being written")

    # --- documents --------------------------------------------------------------------------------------------------

    def _shaped(self, rows: DataFrame, name: str) -> DataFrame:
        """The dataset's columns, null where the rows have none."""
        fields = _parse_datatype_string(TABLES[name])
        return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))

    def save(self, documents: DataFrame, entities: DataFrame | None = None, chunks: DataFrame | None = None) -> None:
        """Inserts documents, replacing those with the same id together with their entities and chunks."""
        new = documents.withColumn("text", F.substring("text", 1, LONGEST_TEXT))
        if "created_at" not in new.columns:
            new = new.withColumn("created_at", F.current_timestamp())
        ids = documents.select("document_id").distinct()
        buckets = {str(r[0]) for r in ids.select(_bucket(F.col("document_id"))).distinct().collect()}  # at most BUCKETS
        parts = {"documents": new, "entities": entities, "chunks": chunks}

        def rows(name: str, old: DataFrame) -> DataFrame:
            kept = old.join(ids, "document_id", "left_anti")
            return kept if parts[name] is None else kept.unionByName(self._shaped(parts[name], name))

        if buckets:
            self._change(buckets, rows)

    def get(self, document_id: str) -> DataFrame:
        """One document; only its bucket is read."""
        bucket = {str(self.spark.range(1).select(_bucket(F.lit(document_id))).first()[0])}
        return self._table("documents", self._newest()[1], bucket).filter(F.col("document_id") == document_id).limit(1)

    def page(self, limit: int = 100, offset: int = 0) -> DataFrame:
        """The newest documents first; ties by id."""
        return self.table("documents").orderBy(F.desc("created_at"), "document_id").offset(offset).limit(limit)

    def count(self) -> int:
        return self.table("documents").count()

    def delete_all(self, ids: DataFrame) -> None:
        """Removes the documents of a table of document_id, with their entities and chunks."""
        ids = ids.select("document_id").distinct()
        buckets = {str(r[0]) for r in ids.select(_bucket(F.col("document_id"))).distinct().collect()}  # at most BUCKETS
        if buckets:
            self._change(buckets, lambda _, old: old.join(ids, "document_id", "left_anti"))

    def delete(self, document_id: str) -> bool:
        """Removes a document with its entities and chunks; whether it was there."""
        if not self.get(document_id).count():
            return False
        self.delete_all(self.spark.createDataFrame([(document_id,)], "document_id string"))
        return True
