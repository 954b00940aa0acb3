"""Incremental annotation files with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from axisframe.operators.contracts import ContractError
from axisframe.operators.joins import manifest_diff


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def reject_duplicate_success(batch: DataFrame, stored: DataFrame, order: Sequence[str | Column] = ()
                             ) -> tuple[DataFrame, DataFrame]:
    """New successes once each, and those whose id was completed before or twice in the batch.

    Of a success that the batch repeats, the first by ``order`` stays; without one (and among equals)
    it is the smallest row by its JSON text, so that a second run keeps the same row.
    """
    good = batch.where(F.col("status") == "ok")
    row = F.struct(*batch.columns)
    once = (good.groupBy("image_id").agg(F.min_by(row, F.struct(*order, F.to_json(row).alias("_text"))).alias("_row"),
                                         F.count("*").alias("_n")))
    known = stored.select("image_id").distinct()
    twice = once.join(known, "image_id", "left_semi").select("image_id").unionByName(
        once.where("_n > 1").select("image_id"))
    return (once.select("image_id", "_row").join(known, "image_id", "left_anti").select("_row.*"), twice.distinct())


def resume_compatibility(spark: SparkSession, metadata_path: str, output_path: str,
                         expected: Mapping[str, str | None],
                         defaults: Mapping[str, str | None] | None = None) -> None:
    """Refuse to append when run parameters differ or output exists without metadata."""
    schema = T.StructType([T.StructField("key", T.StringType()),
                           T.StructField("value", T.StringType())])
    wanted = spark.createDataFrame(list(expected.items()), schema)
    known = _stored(spark, metadata_path, schema)
    if known.isEmpty():
        try:
            orphan = not spark.read.parquet(output_path).isEmpty()
        except AnalysisException:
            orphan = False
        if orphan:
            raise ContractError(f"{output_path} holds rows without metadata of their run")
        wanted.coalesce(1).write.mode("overwrite").parquet(metadata_path)
        return
    differences = manifest_diff(known, wanted, keys=list(expected), defaults=defaults).collect()
    if differences:
        raise ContractError("this run differs from the one to resume: "
                            f"{[row.asDict() for row in differences]}")


#: The order of lines: older files first, then their names, then the place in the file.
_PLACE = ["mtime", "file", "block", "pos"]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the lines of a task: streams have no column function for it."""
    seen = 0
    for batch in batches:
        yield batch.append_column("pos", pa.array(np.arange(seen, seen + batch.num_rows)))
        seen += batch.num_rows


def _settled(lines: DataFrame) -> DataFrame:
    """``(folder, image_id, line)``: the earliest success of an id, once in the life of the stream.

    An id's state is one aggregate: its earliest line, how many there were, and the times of the first and
    last batch that had it. These are equal only in the batch that completes the id. A batch keeps its time
    when it runs again. Tasks merge an id's lines before they send them on, and other lines need no state.
    """
    good = lines.where("kind = 'ok'").withColumn("now", F.current_timestamp()).groupBy("name").agg(
        F.min_by("line", F.struct(*_PLACE)).alias("line"), F.count("*").alias("n"),
        F.min("now").alias("since"), F.max("now").alias("latest"))
    result = F.filter(F.array(
        F.when(F.col("since") == F.col("latest"), F.struct(
            F.lit("ok").alias("folder"), F.col("name").alias("image_id"), F.col("line").alias("line"))),
        F.when(F.col("n") > 1, F.struct(
            F.lit("duplicates").alias("folder"), F.col("name").alias("image_id"), F.lit(None).cast("string").alias("line")))),
        lambda r: r.isNotNull())
    free = lines.where("kind <> 'ok'").select(
        F.col("kind").alias("folder"), F.lit(None).cast("string").alias("image_id"), "line")
    return good.select(F.explode(result).alias("r")).select("r.*").unionByName(free)


def _lines(spark: SparkSession, source: str, schema: T.StructType, max_files: int | None) -> DataFrame:
    """The stream of ``(kind, name, line, mtime, file, block, pos)``; ``name`` is the id of a success."""
    # Without this a file that is a week older than the newest one is passed over in silence.
    reader = spark.readStream.option("maxFileAge", "36500d")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    row = F.from_json("value", T.StructType([*schema.fields, T.StructField("_broken", T.StringType())]),
                      {"columnNameOfCorruptRecord": "_broken"})
    kind = (F.when(F.col("row").isNull() | F.col("row._broken").isNotNull(), "broken")
            .when(~F.col("row.status").eqNullSafe("ok"), "errors")
            .when(F.col("row.image_id").isNull(), "broken").otherwise("ok"))
    return (reader.text(source).where(F.trim("value") != "").withColumn("row", row).withColumn("kind", kind)
            .select("kind", F.col("row.image_id").cast("string").alias("name"), F.col("value").alias("line"),
                    F.col("_metadata.file_modification_time").cast("double").alias("mtime"),
                    F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
            .mapInArrow(_numbered, "kind string, name string, line string, mtime double, file string, block long, pos long"))


def ingest_annotations_stream(spark: SparkSession, source: str, target: str, checkpoint: str,
                              schema: T.StructType, max_files: int | None = None) -> int:
    """Append new annotation files to ``target`` and return the number of micro-batches.

    Successes go to ``target/ok``, failures to ``target/errors``, ids of repeated successes to
    ``target/duplicates``, and lines that cannot be parsed by the schema, or are a success without an
    id, to ``target/broken`` as they stand. Blank lines are passed over. Of an id's successes the
    earliest stays (older file, then file name, then line; a later batch never replaces an earlier one).

    Which ids are complete, and by which line, is keyed state of the stream, so a batch looks up its own ids
    and reads nothing of what was written before. The state is part of ``checkpoint``: a new checkpoint for a
    target that holds rows is refused. A file is never read twice. ``foreachBatch`` may run a batch
    again after a failure; it starts from the same state, and every write replaces the folder of its batch.
    """
    stored = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    try:
        spark.read.text(f"{checkpoint}/metadata")
    except AnalysisException:
        if not _stored(spark, f"{target}/ok", stored).isEmpty():
            raise ContractError(f"{target} holds rows that the new checkpoint {checkpoint} does not know") from None
    batches = 0
    identity = schema["image_id"].dataType

    def write(batch: DataFrame, number: int) -> None:
        nonlocal batches
        kept = batch.persist()
        try:
            def part(folder: str) -> DataFrame:
                return kept.where(F.col("folder") == folder)

            for folder in ("ok", "errors"):
                part(folder).select(F.from_json("line", schema).alias("row")).select("row.*").write.mode(
                    "overwrite").parquet(f"{target}/{folder}/batch={number}")
            part("duplicates").select(F.col("image_id").cast(identity)).write.mode(
                "overwrite").parquet(f"{target}/duplicates/batch={number}")
            part("broken").select("line").write.mode("overwrite").parquet(f"{target}/broken/batch={number}")
        finally:
            kept.unpersist()
        batches += 1

    settled = _settled(_lines(spark, source, schema, max_files))
    # State of any size lies on the executors' disks and in the checkpoint, not in their heaps.
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = (settled.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
                 .foreachBatch(write).trigger(availableNow=True).start())
    finally:
        spark.conf.set(name, before)
    query.awaitTermination()
    return batches


def read_ingested(spark: SparkSession, target: str, schema: T.StructType,
                  folder: str = "ok") -> DataFrame:
    """The rows of one folder; ``schema`` is the table's own, ``line string`` for ``broken``."""
    return _stored(spark, f"{target}/{folder}", T.StructType(
        [*schema.fields, T.StructField("batch", T.LongType())]))
