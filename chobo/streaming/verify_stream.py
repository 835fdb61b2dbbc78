"""Streams of extraction requests, verified against the registry as it is: a stream-static join.

Two services. ``start`` answers every request by itself, as the service's single call does. ``start_cases`` answers every
case once: requests that share an id and follow each other within a gap are one case, of which the last request counts.
A case is kept in keyed state (a session window) until the watermark has passed its end; then it is answered and its
state goes, so state is bounded by the cases that are open. Late requests of a closed case are dropped by the watermark.

Each batch is verified as a table is, the registry is read anew by every batch, so that a new snapshot takes effect
without a restart, and a batch that is repeated after a failure replaces its own files: an answer is written once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chobo.functions.untyped import first_object, parsed
from chobo.operators.verify import LAYERS, verify, verify_asked

REQUEST = "id string, at timestamp, number bigint, extraction string, layers array<string>"
"""at: event time; number: order of requests of the same time; layers: those asked for, all if there is none."""
ANSWER = "id string, requests bigint, number bigint, approved boolean, reasons array<string>, registry_status string, name_match string, tax_convention array<string>, decision string"


def requests(spark: SparkSession, path: str, schema: str = "id string, extraction string", files: int | None = None) -> DataFrame:
    """Requests from JSON files as they arrive; files: at most so many of them in a batch, the oldest first."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).json(path)


def _decided(verified: DataFrame) -> DataFrame:
    return verified.withColumn("decision", F.when(F.col("approved"), "approve").otherwise("review"))


def verify_requests(rows: DataFrame, registry: DataFrame, layers=LAYERS) -> DataFrame:
    """id, decision, approved, reasons, registry_status, name_match, tax_convention of each request.

    Rows with a column ``layers`` are verified with the layers that each asks for, others with those given here.
    """
    own = "layers" in rows.columns
    asked = parsed(rows, first_object(F.col("extraction"))).select("id", "parsed", *(["layers"] if own else []))
    out = verify_asked(asked, registry) if own else verify(asked, registry, layers)
    return _decided(out.drop("parsed", "layers"))


def cases(rows: DataFrame, gap: str, delay: str = "0 seconds") -> DataFrame:
    """id, requests (how many), number, extraction, layers: the last request of each case, of a stream or of a table.

    Requests of an id less than ``gap`` apart are one case; of a stream, requests later than ``delay`` behind the latest
    one do not count, nor does a row without time. Rows without id are cases of none, which answer() leaves out; they
    keep the clock going. (A filter on the id here would be moved before the clock.)
    """
    s = rows.withWatermark("at", delay) if rows.isStreaming else rows
    last = F.max_by(F.struct("number", "extraction", "layers"), F.struct("at", "number"))
    closed = s.filter("at is not null").groupBy(F.session_window("at", gap), "id").agg(F.count("*").alias("requests"), last.alias("last"))
    return closed.select("id", "requests", "last.*")


def answer(last: DataFrame, registry: DataFrame) -> DataFrame:
    """The columns of ANSWER for the last requests of cases that have an id."""
    asked = parsed(last.filter("id is not null"), first_object(F.col("extraction"))).select("id", "requests", "number", "layers", "parsed")
    return _decided(verify_asked(asked, registry).drop("parsed", "layers")).select(*[c.split()[0] for c in ANSWER.split(", ")])


def _run(stream: DataFrame, verified: Callable[[DataFrame, DataFrame], DataFrame], registry_path: str, sink: str, checkpoint: str) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            # many batches close no case: they are not planned for nothing
            if not batch.isEmpty():
                registry = batch.sparkSession.read.parquet(registry_path)
                verified(batch, registry).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start(spark: SparkSession, source: str, registry_path: str, sink: str, checkpoint: str, layers=LAYERS) -> StreamingQuery:
    """Verify all requests below ``source``, now and as they come, into Parquet files below ``sink``."""
    return _run(requests(spark, source), lambda rows, registry: verify_requests(rows, registry, layers), registry_path, sink, checkpoint)


def start_cases(spark: SparkSession, source: str, registry_path: str, sink: str, checkpoint: str, gap: str, delay: str = "0 seconds", files: int | None = None) -> StreamingQuery:
    """Answer all cases of the requests (REQUEST) below ``source`` that have ended, and go on from ``checkpoint`` next time."""
    return _run(cases(requests(spark, source, REQUEST, files), gap, delay), answer, registry_path, sink, checkpoint)


def answers(spark: SparkSession, sink: str) -> DataFrame:
    """What start_cases has written so far."""
    return spark.read.schema(ANSWER).parquet(f"{sink}/batch=*")


def health(registry: DataFrame) -> DataFrame:
    """One row: status, registrants, layers."""
    return registry.agg(F.lit("ok").alias("status"), F.count("*").alias("registrants")).withColumn("layers", F.array(*map(F.lit, LAYERS)))
