"""Requests as a stream: parse, answer, append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from perchero.operators.candidates import Predictor
from perchero.operators.recommend import best_outfits, context_log, read_messages, respond_to
from perchero.session import scratch_path, scratch_scope
from perchero.sources.storage import write_table
from perchero.sources.tables import append_contexts


def read_stream(spark: SparkSession, path: str, schema: T.StructType,
                files_per_trigger: int = 1) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def recommend_stream(requests: DataFrame, users: DataFrame, garments: DataFrame,
                     predictor: Predictor, out: str, checkpoint: str) -> StreamingQuery:
    """Best outfit per request, appended. Request ids are unique, so no state is kept.

    Each batch goes to its own folder, overwritten when a batch is repeated after a failure:
    a request is answered exactly once.
    """
    def answer(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession):
            best = best_outfits(batch, users, garments, predictor)
            best.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def message_stream(messages: DataFrame, users: DataFrame, garments: DataFrame,
                   predictor: Predictor, out: str, contexts: str,
                   checkpoint: str) -> StreamingQuery:
    """Responses per message, and the context rows they append. A batch is read and parsed once,
    and its intermediate tables go with it."""
    def answer(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch_scope(spark):
            read = write_table(read_messages(batch, users), scratch_path(spark, "messages"))
            append_contexts(context_log(read), f"{contexts}/batch={batch_id}", mode="overwrite")
            responses = respond_to(read, users, garments, predictor)
            responses.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        messages.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
