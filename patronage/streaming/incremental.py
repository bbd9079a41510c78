"""Purchase totals per customer over a stream.

``purchase_totals`` is built from min, max, count and sum, so it is already a streaming aggregation:
Structured Streaming keeps one small state row per customer and merges each micro-batch into it. The
batch functions turn the current totals into RFM or BG/NBD inputs.

*Commits.* Below ``path`` lie ``data`` (one folder per batch or compaction, never changed once listed), ``manifest`` (numbered
lists of the folders that count) and, unless another is named, ``checkpoint``. A batch or a compaction first writes its folder,
then the next manifest: that one small file is the switch. Readers take the newest whole manifest. What breaks off
before the switch has not happened, and a batch that runs again after its switch finds itself listed. Folders that no
manifest lists are removed by the next compaction.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from patronage.errors import InputProblem
from patronage.functions.dates import moment
from patronage.operators.summaries import When, bgnbd_from_totals, purchase_totals, rfm_from_totals

EMPTY = {"version": 0, "stream": None, "last": -1, "folders": []}


class _Files:
    """A folder on any file system that Hadoop reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.root = spark.sparkContext._jvm, path.rstrip("/")
        self.system = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self.system.listStatus(path)] if self.system.exists(path) else []

    def text(self, name: str) -> str | None:
        path = self._path(name)
        if not self.system.exists(path):
            return None
        stream = self.system.open(path)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a new file; False if there is one of that name."""
        try:
            stream = self.system.create(self._path(name), False)
        except Py4JJavaError:
            if self.system.exists(self._path(name)):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def delete(self, name: str) -> None:
        self.system.delete(self._path(name), True)


def _manifest(files: _Files) -> dict:
    """The newest whole manifest. One that broke off while it was written has no end and does not count."""
    for number in sorted((int(n) for n in files.names("manifest") if n.isdigit()), reverse=True):
        text = files.text(f"manifest/{number}") or ""
        if text.endswith("\n"):
            return json.loads(text)
    return dict(EMPTY)


def _switch(files: _Files, old: dict, **changes) -> bool:
    """Puts the next manifest in place; False if another writer was faster."""
    # Numbers of manifests that broke off are not used again.
    number = max([old["version"], *(int(n) for n in files.names("manifest") if n.isdigit())]) + 1
    if _manifest(files)["version"] != old["version"]:
        return False
    return files.create(f"manifest/{number}", json.dumps(old | changes | {"version": number}) + "\n")


def stream_totals(purchases: DataFrame, customer: str, date: str, amount: str, path: str,
                  checkpoint: str | None = None, **trigger) -> StreamingQuery:
    """Adds the changed customers of every micro-batch to the totals under ``path``; each batch counts once.

    The stream's checkpoint lies below ``path`` unless another place is named. Totals belong to one stream: a stream that
    starts anew, with another checkpoint, does not know the customers' earlier purchases and is refused.
    """
    if not purchases.isStreaming:
        raise InputProblem("This is not a streaming table.", "Use purchase_totals for a batch.")
    totals = purchase_totals(purchases, customer, date, amount)
    place = (checkpoint or f"{path.rstrip('/')}/checkpoint").rstrip("/")

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        files = _Files(spark, path)
        stream = json.loads(_Files(spark, place).text("metadata") or "{}").get("id")
        now = _manifest(files)
        if now["stream"] not in (None, stream):
            raise InputProblem(f"The totals under {path} belong to another stream.",
                               "Go on with that stream's checkpoint, or choose another path.")
        if number <= now["last"]:
            # Listed already; the stream's own state still needs the batch.
            batch.write.format("noop").mode("append").save()
            return
        folder = f"batch={number}/part={uuid.uuid4().hex}"
        batch.write.parquet(f"{files.root}/data/{folder}")
        while not _switch(files, now, stream=stream, last=number, folders=[*now["folders"], folder]):
            now = _manifest(files)  # a compaction came between

    return totals.writeStream.outputMode("update").option("checkpointLocation", place) \
        .foreachBatch(keep).trigger(**(trigger or {"availableNow": True})).start()


def read_updates(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all batches that count, with the number of their ``batch``."""
    files = _Files(spark, path)
    folders = _manifest(files)["folders"]
    if not folders:
        raise InputProblem(f"No batch has been written to {path}.")
    data = f"{files.root}/data"
    return spark.read.option("basePath", data).parquet(*[f"{data}/{f}" for f in folders]).drop("part")


def current_totals(updates: DataFrame, customer: str) -> DataFrame:
    """The newest totals per customer from ``read_updates``."""
    values = [c for c in updates.columns if c not in (customer, "batch")]
    newest = updates.groupBy(customer).agg(F.max_by(F.struct(*values), "batch").alias("t"))
    return newest.select(customer, "t.*")


def compact_totals(spark: SparkSession, path: str, customer: str) -> None:
    """Puts one folder of newest totals in place of one per batch, so that reads stop growing.

    It may run beside the stream: batches that come meanwhile stay listed after the compacted folder. Folders that no manifest
    lists go last; do not compact while a reader of older folders is still running.
    """
    files = _Files(spark, path)
    before = _manifest(files)
    if not before["folders"]:
        return
    folder = f"batch={before['last']}/part={uuid.uuid4().hex}"
    current_totals(read_updates(spark, path), customer).write.parquet(f"{files.root}/data/{folder}")
    now = before
    while not _switch(files, now, folders=[folder, *[f for f in now["folders"] if f not in before["folders"]]]):
        now = _manifest(files)
    _sweep(files, before)


def _sweep(files: _Files, before: dict) -> None:
    """Removes folders of batches up to ``before`` that the newest manifest does not list, then older manifests."""
    now = _manifest(files)
    for batch in files.names("data"):
        number = batch.removeprefix("batch=")
        if number.isdigit() and int(number) <= before["last"]:
            for part in files.names(f"data/{batch}"):
                if f"{batch}/{part}" not in now["folders"]:
                    files.delete(f"data/{batch}/{part}")
            if not files.names(f"data/{batch}"):
                files.delete(f"data/{batch}")
    for number in files.names("manifest"):
        if number.isdigit() and int(number) < before["version"]:
            files.delete(f"manifest/{number}")


def rfm_now(totals: DataFrame, customer: str, observation_date: When = None) -> DataFrame:
    """RFM inputs as of ``observation_date`` (default: the latest purchase)."""
    ends = totals.agg(F.struct(F.min("first_purchase").alias("start"),
                               F.max("last_purchase").alias("end"))).scalar()
    end = moment(observation_date) if observation_date is not None else F.col("_ends.end")
    return rfm_from_totals(totals.withColumn("_ends", ends), customer, F.col("_ends.start"), end)


def bgnbd_now(totals: DataFrame, customer: str, end: When = None, unit: str = "weeks") -> DataFrame:
    """x, tx and T as of ``end`` (default: the latest purchase)."""
    final = moment(end) if end is not None else totals.agg(F.max("last_purchase")).scalar()
    return bgnbd_from_totals(totals.withColumn("_end", final), customer, F.col("_end"), unit)
