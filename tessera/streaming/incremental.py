"""New documents as a stream: typed, chunked and embedded once, appended to the chunk table.

Each micro-batch keeps only chunks that the table does not have, so a batch that is run again after a failure adds
nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.providers import HashEmbedder, map_provider
from ..operators import chunk_quality, chunking, ingest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def chunk_documents(docs: DataFrame, embed: bool = True) -> DataFrame:
    """Sections' best chunks with ids, and embeddings from the offline provider."""
    sections = ingest.typed(ingest.sections_view(docs))
    carry = ("text", "item_number", "section_type", "numerical_density")
    wanted = sections.withColumns({"numerical_density": F.col("signals.numerical_density"), "strategies": chunking.candidates(F.col("section_type"), F.col("signals.table_density"), F.col("signals.token_count"), use_pattern=False)})
    scored = chunk_quality.score(chunking.chunk_sections(wanted, carry=carry))
    chunks = chunking.materialise(chunk_quality.winners(scored), sections).withColumn("chunk_key", F.concat_ws(":", "doc_id", "chunk_index"))
    return map_provider(chunks, "text", "embedding", "array<float>", HashEmbedder, "embed") if embed else chunks


def append_new(docs: DataFrame, path: str) -> None:
    """Appends chunks of docs that the table at path does not have yet."""
    spark = docs.sparkSession
    made = chunk_documents(docs, embed=False)
    try:
        made = made.join(spark.read.parquet(path).select("chunk_key"), "chunk_key", "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    map_provider(made, "text", "embedding", "array<float>", HashEmbedder, "embed").write.mode("append").parquet(path)


def stream_documents(spark: SparkSession, source: str, path: str, checkpoint: str) -> StreamingQuery:
    """Runs over all documents that arrive at source (Parquet files) and ends when none are left."""
    docs = spark.readStream.schema(DOCUMENT).parquet(source)
    return docs.writeStream.foreachBatch(lambda batch, _: append_new(batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums of events by type in windows of event time; works on streams and on tables."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    return kept.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
