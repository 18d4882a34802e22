"""Documents as they arrive: the stateless operators on a stream, and upserts of each batch into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom.operators import classify, entities
from paperloom.plans.store import DocumentStore


def document_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def enriched(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """document_id, text, document_type, confidence, entities: no window or join, so it runs on streams and tables alike."""
    rows = classify.rule_classified(docs.select(F.col(doc_id).cast("string").alias("document_id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    found = entities.linked(F.col("text"), entities.deduplicated(entities.recognised(F.col("text"))))
    return rows.select("document_id", "text", "document_type", "confidence", found.alias("entities"))


def ingest(docs: DataFrame, store: DocumentStore, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Every batch is saved whole; of repeated ids within a batch one row stays."""

    def save(batch: DataFrame, _: int) -> None:
        rows = batch.dropDuplicates(["document_id"]).persist()
        try:
            e = rows.select("document_id", F.explode("entities").alias("e")).select("document_id", "e.*")
            store.save(rows.drop("entities"), e)
        finally:
            rows.unpersist()

    writer = enriched(docs).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
