"""A folder converted continuously: each new file once, outputs and errors as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from bytefold.plans.convert import Params, convert_files
from bytefold.sources import files


def watch(spark: SparkSession, inbox: str, outbox: str, log: str, to: str, checkpoint: str, params: Params = Params(), once: bool = False) -> StreamingQuery:
    """Files that appear in `inbox` are converted into `outbox`; a row for each goes to Parquet `log`."""
    source = spark.readStream.format("binaryFile").schema(files.FILE).load(inbox)

    def step(batch: DataFrame, epoch: int) -> None:
        done = convert_files(batch, to, params, outbox).persist()
        files.write_files(done.where("error is null"), "out_path").write.mode("overwrite").format("noop").save()
        done.drop("content").write.mode("append").parquet(log)
        done.unpersist()

    writer = source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
