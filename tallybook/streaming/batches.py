"""Batches at rest: folders by month, and a list of the folders that count, renewed as a whole."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONTH = "month"
BATCH = "batch"
NO_MONTH = 0


def month_of(day: str) -> Column:
    """A month as a number such as 200112; rows without a date are kept under 0."""
    return F.coalesce(F.year(day) * 100 + F.month(day), F.lit(NO_MONTH))


class Batches:
    """Rows written batch by batch below ``target``.

    Readers see the folders of the newest list. A batch is first written and then listed, so a batch that is written
    again replaces what it wrote before, and neither a failed writer nor a compaction ever shows half its rows.
    """

    def __init__(self, spark: SparkSession, target: str, schema: T.StructType, day: str = "txn_date") -> None:
        self.spark, self.target, self.schema, self.day = spark, target.rstrip("/"), schema, day
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _lists(self) -> str:
        return f"{self.target}/_lists"

    def current(self) -> tuple[int, list[dict]]:
        """The number of the newest list, 0 before the first, and its entries ``folder, source_id, last``."""
        if not self.files.exists(self.path(self._lists())):
            return 0, []
        newest = max((f.getPath().getName() for f in self.files.listStatus(self.path(self._lists())) if f.getPath().getName().endswith(".json")), default=None)
        if newest is None:
            return 0, []
        text = self.spark.read.text(f"{self._lists()}/{newest}", wholetext=True).first()[0]
        return int(newest.removesuffix(".json")), json.loads(text)

    def _commit(self, replaced, entry: dict) -> None:
        """List ``entry`` instead of the entries that ``replaced`` picks. Whoever lists first wins; the other tries again."""
        while True:
            version, entries = self.current()
            listed = [e for e in entries if not replaced(e)] + [entry]
            # written aside and renamed, as a name that is taken cannot be renamed to
            staged, final = self.path(f"{self._lists()}/.{uuid.uuid4().hex}"), self.path(f"{self._lists()}/{version + 1:012d}.json")
            out = self.files.create(staged, True)
            out.write(bytearray(json.dumps(listed).encode()))
            out.close()
            try:
                if not self.files.exists(final) and self.files.rename(staged, final):
                    return
            except Py4JJavaError:
                if not self.files.exists(final):
                    raise
            self.files.delete(staged, False)

    def _write(self, rows: DataFrame, gathered: bool = False) -> str:
        folder = f"{BATCH}={uuid.uuid4().hex}"
        monthly = rows.withColumn(MONTH, month_of(self.day))
        # a month is gathered in few files; one that holds very many rows is split
        (monthly if gathered else monthly.hint("rebalance", MONTH)).write.partitionBy(MONTH).parquet(f"{self.target}/{folder}")
        return folder

    def _read(self, entries: list[dict]) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(BATCH, T.StringType()), T.StructField(MONTH, T.IntegerType())])
        if not entries:
            # known to be empty by the planner, which leaves out what is joined with it
            return self.spark.range(1).limit(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
        return self.spark.read.schema(schema).option("basePath", self.target).parquet(*[f"{self.target}/{e['folder']}" for e in entries])

    def rows(self, months: list[int] | None = None) -> DataFrame:
        """All rows, or those of a few months, of which alone the files are read."""
        found = self._read(self.current()[1])
        return (found if months is None else found.filter(F.col(MONTH).isin(months))).drop(BATCH, MONTH)

    def put(self, rows: DataFrame, source_id: str, batch_id: int, gathered: bool = False) -> None:
        """Store a batch in the place of what was stored for it before. Rows of which each task has few months (``gathered``) are not moved."""
        entry = {"folder": self._write(rows.select(*self.schema.fieldNames()), gathered), "source_id": source_id, "last": batch_id}
        self._commit(lambda e: (e["source_id"], e["last"]) == (source_id, batch_id), entry)

    def compact(self, least: int = 2) -> bool:
        """Join the folders of all batches but the last of each stream, which alone may be written again.

        Rows are sorted into ranges of days, so a month is in few files however many batches brought it.
        """
        entries = self.current()[1]
        latest = {s: max(e["last"] for e in entries if e["source_id"] == s) for s in {e["source_id"] for e in entries}}
        old = [e for e in entries if e["last"] < latest[e["source_id"]] or e["source_id"] == ""]
        if len(old) < least:
            return False
        ranged = self._read(old).repartitionByRange(MONTH, self.day).sortWithinPartitions(MONTH, self.day).drop(BATCH, MONTH)
        names = {e["folder"] for e in old}
        self._commit(lambda e: e["folder"] in names, {"folder": self._write(ranged, gathered=True), "source_id": "", "last": -1})
        return True

    def vacuum(self) -> int:
        """Delete the folders that the newest list leaves out, once nobody reads them any more; their number."""
        kept = {e["folder"] for e in self.current()[1]}
        found = [f.getPath() for f in self.files.listStatus(self.path(self.target)) if f.getPath().getName().startswith(f"{BATCH}=")]
        left = [p for p in found if p.getName() not in kept]
        for p in left:
            self.files.delete(p, True)
        return len(left)
