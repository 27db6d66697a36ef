"""Incremental ingest of new statement files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.operators.quality import collapse_copies, fingerprint, fit_in_tasks, gathered, marks_of, match_nulls, split_marked, written_out
from tallybook.operators.rules import tag_ledger
from tallybook.plans.load import load_ledger
from tallybook.schema import COPY_KEY, LEDGER, RAW_LEDGER
from tallybook.session import discard, free_shuffles, staged
from tallybook.sources.registry import read_source
from tallybook.streaming.batches import MONTH, Batches, month_of

STATUS = "status"
STORED = T.StructType([*LEDGER.fields, T.StructField(STATUS, T.StringType()), T.StructField("source_id", T.StringType()), T.StructField("batch_id", T.LongType())])


def store(spark: SparkSession, target: str) -> Batches:
    return Batches(spark, target, STORED)


def ledger_so_far(spark: SparkSession, target: str) -> DataFrame:
    """All ingested rows with their status and batch; empty before the first batch."""
    return store(spark, target).rows()


def mark_repeats(batch: DataFrame, history: DataFrame, key: list[str] = COPY_KEY) -> DataFrame:
    """Label each batch row ``new`` or ``repeat``.

    Rows of a copy key that history has are repeats. Otherwise those of one file, the
    first by name, are new: equal rows inside a file are purchases of their own, equal rows of another
    file are the same purchases delivered again.
    """
    counted = staged(collapse_copies(batch), "counted")
    kept = history.select(*key).withColumns({"n": F.lit(0).cast("bigint"), "seen": F.lit(True)})
    both = counted.withColumn("seen", F.lit(False)).unionByName(kept, allowMissingColumns=True)
    values = {"first_file": F.min(F.when(~F.col("seen"), F.struct("source_file"))), "known": F.bool_or("seen")}
    if fit_in_tasks(both, key):
        together, place = gathered(both, key)
        group = Window.partitionBy(*place, *[c for c in key if c not in place])
        joined = together.withColumns({c: v.over(group) for c, v in values.items()})
    else:
        joined = match_nulls(both, both.groupBy(*key).agg(*[v.alias(c) for c, v in values.items()]), key)
    fresh = F.when(~F.col("known") & F.col("source_file").eqNullSafe(F.col("first_file.source_file")), F.col("n")).otherwise(0)
    split = joined.filter("not seen").select(*batch.columns, F.explode(F.array(
        F.struct(F.lit("new").alias(STATUS), fresh.cast("bigint").alias("copies")),
        F.struct(F.lit("repeat").alias(STATUS), (F.col("n") - fresh).alias("copies")),
    )).alias("part")).select(*batch.columns, f"part.{STATUS}", "part.copies").filter("copies > 0")
    marked = staged(split, "marked")
    discard(counted)
    done = written_out(marked, "copies", by=["txn_date"] if "txn_date" in batch.columns else batch.columns).select(*batch.columns, STATUS)
    # For who stores the rows and then needs no more of them.
    done.scratch = marked.scratch
    return done


def write_batch(batch: DataFrame, batch_id: int, rules: DataFrame, target: str, source_id: str = "direct") -> None:
    """Tag one batch of raw rows, mark repeats against earlier batches, and store it.

    A replay replaces what the batch stored before; another stream, which counts its batches from 0 too, has
    another ``source_id``. Of history only the months of the batch are read, and only rows that look like one of the batch go further.

    The batch is gathered by month when it is staged, and its rows stay so: what looks like nothing else is stored from where it is, the
    others are moved into ranges of days.
    """
    spark, at = batch.sparkSession, store(batch.sparkSession, target)
    arrived = staged(tag_ledger(batch, rules), "arrived")
    # Bounded by the calendar.
    months = [r[0] for r in arrived.select(month_of("txn_date")).distinct().collect()]
    if not months:
        return
    tagged = staged(arrived.withColumn(MONTH, month_of("txn_date")).hint("rebalance", MONTH).drop(MONTH), "batch")
    discard(arrived)
    own_or_later = (F.col("source_id") == source_id) & (F.col("batch_id") >= batch_id)
    history = at.rows(months).filter(~own_or_later & (F.col(STATUS) == "new")).select(*COPY_KEY)
    looks = fingerprint(COPY_KEY).alias("fingerprint")
    both = tagged.select(looks, F.lit(1).alias("own"), F.lit(0).alias("kept")).unionByName(history.select(looks, F.lit(0).alias("own"), F.lit(1).alias("kept")))
    sizes = both.groupBy("fingerprint").agg(F.sum("own").alias("own"), F.max("kept").alias("kept"))
    doubtful = marks_of(sizes.filter("own > 1 or own = 1 and kept = 1").select("fingerprint"))
    # All other rows are new: nothing in the batch or in history looks like them.
    fresh, alike = split_marked(tagged, COPY_KEY, doubtful)
    marked = mark_repeats(alike, split_marked(history, COPY_KEY, doubtful)[1])
    rows = fresh.withColumn(STATUS, F.lit("new")).unionByName(marked)
    at.put(rows.withColumns({"source_id": F.lit(source_id), "batch_id": F.lit(batch_id).cast("bigint")}), source_id, batch_id, gathered=True)
    discard(tagged, marked)
    free_shuffles(spark)


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the stream of this checkpoint; a renewed checkpoint has another."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]


def ingest(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    rules: DataFrame,
    archive: str | None = None,
    max_files: int = 1000,
    kind: str = "ledger_csv",
    compact_after: int = 50,
) -> None:
    """Read the statement files of a kind of the source registry not read before, then stop.

    The stream carries the names of new files, ``max_files`` to a batch, and each batch is read by the reader that a plain load uses,
    so a statement comes out the same whichever way it is loaded. ``archive`` (outside the source tree) receives files once a later batch
    commits. When more than ``compact_after`` batches are listed afterwards, they are compacted.
    """
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    reader = reader.option("maxFilesPerTrigger", max_files)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)

    def take(files: DataFrame, batch_id: int) -> None:
        paths = [r["path"] for r in files.collect()]
        if paths:
            write_batch(read_source(spark, kind, paths), batch_id, rules, target, _stream_id(spark, checkpoint))

    query = (
        reader.load(source).select("path").writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    at = store(spark, target)
    if len(at.current()[1]) > compact_after:
        at.compact()


def ingest_statements(spark: SparkSession, sources: dict[str, str], target: str, state: str, rules: DataFrame, **options) -> None:
    """Ingest the folders ``sources`` (kind to path) into one ledger, each kind by a stream of its own below ``state``."""
    for kind, source in sources.items():
        ingest(spark, source, target, f"{state.rstrip('/')}/{kind}", rules, kind=kind, **options)


def load_ingested(spark: SparkSession, target: str, rules: DataFrame, **load) -> DataFrame:
    """The accepted rows through the load step: tagged by the rules of today, with its filters and suffixes."""
    accepted = ledger_so_far(spark, target).filter(F.col(STATUS) == "new")
    return load_ledger(accepted.select(*RAW_LEDGER.fieldNames()), rules=rules, **load)


def retag_history(spark: SparkSession, target: str, rules: DataFrame) -> DataFrame:
    """All accepted rows tagged again, for use after the rules changed."""
    accepted = ledger_so_far(spark, target).filter(F.col(STATUS) == "new")
    return tag_ledger(accepted.select(*RAW_LEDGER.fieldNames()), rules)
