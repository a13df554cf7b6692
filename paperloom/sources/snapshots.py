"""Results of stages, kept under the content that they were made from.

A stage's result is a row for each document: its id, the key of what went in, whatever came out, and an error. A run
computes only documents whose key isn't kept yet and appends them; all else is read. As the key is a digest of the
columns that the stage gets, not of the run or the stage before, a stage isn't run again for a document whose inputs
came out as they were. A document that had an error is tried again by the next run.

Keeping is an append of Parquet files below one folder for each stage, a folder in it for each append: what an
interrupted run has not committed is computed again, what it has committed isn't. Where nothing was kept before, the
append is the result as it stands and nothing is looked up. What a stage writes for itself goes when it is committed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name below spark.checkpoint.dir, which driver and executors share."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = kept.get() if kept.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: The column with the digest of what a stage gets; a stage's function gives it back with each row.
KEY = "_key"


def carried(frame: DataFrame) -> list[str]:
    """The key's column, where the frame has it."""
    return [KEY] if KEY in frame.columns else []


def met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of documents by sorting, never by a broadcast.

    Spark guesses the rows of a side from the size of its files, and rows that are much alike are next to nothing in
    them: a side with a row for each document would be taken for small and go through the driver whole.
    """
    return left.join(right.hint("merge"), on, how)


def kept(frame: DataFrame, uri: str) -> DataFrame:
    """The rows of frame, written once and read again from uri."""
    frame.write.option("compression", "zstd").parquet(uri)
    return frame.sparkSession.read.schema(frame.schema).parquet(uri)


class Snapshots:
    """What stages gave, below one folder. run: the name under which this run's new rows are marked."""

    def __init__(self, spark: SparkSession, folder: str, run: str = ""):
        self.spark, self.folder, self.run = spark, folder.rstrip("/"), run or uuid.uuid4().hex
        self._own: list[str] = []

    def _path(self, stage: str) -> str:
        return f"{self.folder}/{stage}"

    def _at(self, path: str):
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return there.getFileSystem(self.spark._jsc.hadoopConfiguration()), there

    def _exists(self, path: str) -> bool:
        system, there = self._at(path)
        return system.exists(there)

    def scratch(self, frame: DataFrame, name: str) -> DataFrame:
        """Rows needed more than once; inside a stage they go with its commit."""
        self._own.append(f"{self.folder}/_scratch/{name}-{uuid.uuid4().hex}")
        return kept(frame, self._own[-1])

    def _drop(self, since: int) -> None:
        for path in self._own[since:]:
            system, there = self._at(path)
            system.delete(there, True)
        del self._own[since:]

    def all(self, stage: str) -> DataFrame | None:
        """All rows ever kept for a stage, with the run that made them."""
        path = self._path(stage)
        return self.spark.read.parquet(path) if self._exists(path) else None

    def stage(self, name: str, version: str, inputs: DataFrame, compute: Callable[[DataFrame], DataFrame], id_col: str = "doc_id") -> DataFrame:
        """id, what compute gives, error: for every row of inputs, computed or kept.

        compute makes (id, ..., error, _key) of rows of inputs with their _key, one for each. It has to give equal
        results for equal columns; its version is part of the key.
        """
        asked = [c for c in inputs.columns if c != id_col]
        digest = F.sha2(F.concat_ws("|", F.lit(name), F.lit(version), F.to_json(F.struct(*asked), {"ignoreNullFields": "false"})), 256)
        keyed = inputs.withColumn(KEY, F.unhex(digest))
        held, since, todo = self.all(name), len(self._own), keyed
        if held is not None:
            # Only ids and keys are looked up; rows are read again for what is left.
            wanted = self.scratch(keyed.select(id_col, KEY), f"{name}-keys")
            left = self.scratch(met(wanted, held.where("error is null").select(id_col, KEY), [id_col, KEY], "left_anti"), f"{name}-left")
            todo = met(inputs, left, id_col)
        appended = f"{self._path(name)}/append=a{uuid.uuid4().hex}"
        made = compute(todo).withColumn("_run", F.lit(self.run))
        made.write.option("compression", "zstd").parquet(appended)
        if held is None:
            self._drop(since)
            return self.spark.read.schema(made.schema).parquet(appended).drop(KEY, "_run")
        every = self.all(name).where(F.col("error").isNull() | (F.col("_run") == self.run)).drop("_run")
        # A run that was repeated after its commit keeps a row twice: the append to read is told for each id, rows aren't compared.
        last = self.scratch(met(every.select(id_col, KEY, "append"), wanted, [id_col, KEY], "left_semi").groupBy(id_col, KEY).agg(F.max("append").alias("append")), f"{name}-found")
        self._drop_but(since, 1)
        return met(every, last, [id_col, KEY, "append"], "left_semi").drop(KEY, "append")

    def _drop_but(self, since: int, latest: int) -> None:
        """Scratch since then is dropped, but for the latest."""
        stays = self._own[len(self._own) - latest :]
        del self._own[len(self._own) - latest :]
        self._drop(since)
        self._own += stays

    def done(self) -> DataFrame:
        """stage, id of what this run computed."""
        out = None
        for stage in ("prescan", "ocr", "classify", "structure", "decide"):
            rows = self.all(stage)
            if rows is not None:
                mine = rows.where(F.col("_run") == self.run).select(F.lit(stage).alias("stage"), F.col(rows.columns[0]).cast("string").alias("id"))
                out = mine if out is None else out.union(mine)
        return out
