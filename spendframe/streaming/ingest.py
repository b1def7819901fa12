"""Incremental load: pages arrive as files, each is normalised and appended once."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendframe.schema import BILLING_ROW
from spendframe.sources.billing import normalise, split_valid
from spendframe.sources.facts import FactTable


def page_stream(spark: SparkSession, folder: str, file_format: str = "parquet", schema=BILLING_ROW, **options):
    """Files of a folder as a stream of rows."""
    return spark.readStream.schema(schema).options(**options).format(file_format).load(folder)


def load_pages(rows: DataFrame, batch: dict, table_path: str, rejects_path: str, checkpoint: str, prepare=None) -> None:
    """Append the pages that are there now and stop; a rerun continues after the last page.

    Valid rows go into the table, rejected ones with their reasons into a table of their own, by two streams over the
    same pages. `prepare` may add routing and rules; it takes and returns a DataFrame. The file sink and the
    checkpoints give each page exactly once to either table, also when a run is repeated after a failure.
    """
    valid, rejected = split_valid(rows)
    lines = normalise(valid, batch)
    if prepare:
        lines = prepare(lines)
    loads = [
        _append(lines, table_path, f"{checkpoint}/valid", ["data_source_id", "billed_month"]),
        _append(rejected, rejects_path, f"{checkpoint}/rejected", []),
    ]
    for load in loads:
        load.awaitTermination()


def _append(rows: DataFrame, path: str, checkpoint: str, partitions: list[str]):
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.partitionBy(*partitions).outputMode("append").trigger(availableNow=True).start()


def load_pages_in_batches(rows: DataFrame, batch: dict, write_batch, write_rejects, checkpoint: str):
    """Like `load_pages`, for sinks that replace rows: hands each micro-batch to `write_batch(df, batch_id)`.

    `write_rejects` gets the rejected rows with their reasons. Both may be called again with the same id.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        try:
            valid, rejected = split_valid(df)
            write_batch(normalise(valid, batch), batch_id)
            write_rejects(rejected, batch_id)
        finally:
            df.unpersist()

    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def load_into_table(rows: DataFrame, batch: dict, table: FactTable, rejects: FactTable, checkpoint: str, prepare=None) -> tuple[FactTable, FactTable]:
    """Adds the pages that are there now to a fact table, each micro-batch in one step, and rejected rows to a table of their own.

    Every step is noted in the tables' versions under the job, the task and the number of the micro-batch. A micro-batch that the
    stream hands over again, because the run died before its checkpoint, is found there and not added twice; this
    also holds if the run died between the two tables. A failed job's rows can be taken out by `operators.load.roll_back`.
    """
    tables = {"valid": table, "rejected": rejects}

    def add(name: str, part: DataFrame, note: str) -> None:
        if not tables[name].has_note(note):
            tables[name] = tables[name].append(part, note)

    def write(df: DataFrame, batch_id: int) -> None:
        note = f"{batch['job_id']}/{batch['job_task_id']}/{batch_id}"
        valid, rejected = split_valid(df)
        lines = normalise(valid, batch)
        add("valid", prepare(lines) if prepare else lines, note)
        add("rejected", rejected.withColumns({key: F.lit(value) for key, value in batch.items()}), note)

    stream = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    return tables["valid"], tables["rejected"]
