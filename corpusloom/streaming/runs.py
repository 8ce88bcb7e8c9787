"""State as a log of runs: what a batch adds is written beside what is there, and runs are merged as they add up.

A folder holds runs, each the rows of one or more batches in Parquet, and
manifests, each a list of the runs that make up the state after a batch. A
manifest is written under another name and renamed when whole, so readers see all
of a batch or none of it, and a batch that comes again finds itself listed. FAN
runs of a level are merged into one of the next, so a state after n batches is
read from fewer than FAN * (1 + log n / log FAN) runs, and a row is written anew
once a level. Runs that no manifest of the last KEEP names are removed.

What merging means is the owner's: merge(rows, whole) gets the rows of neighbouring
runs with a column `run`, larger for later ones, and gives rows without it; `whole`
says whether nothing lies before them, so that marks of removal can go.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAN, KEEP = 8, 4
Merge = Callable[[DataFrame, bool], DataFrame]


@dataclass(frozen=True)
class Run:
    low: int  # the first and the last batch in it
    high: int
    level: int
    name: str


class RunLog:
    """Runs and manifests below a folder that driver and executors share; one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, merge: Merge, fan: int = FAN, by: tuple[str, ...] = ()):
        self.spark, self.folder, self.merge, self.fan, self.by = spark, folder.rstrip("/"), merge, fan, by
        self.schema = T.StructType.fromDDL(schema) if hasattr(T.StructType, "fromDDL") else spark.createDataFrame([], schema).schema

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    @property
    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        place = self._path(name)
        return [x.getPath().getName() for x in self._files.listStatus(place)] if self._files.exists(place) else []

    def _manifests(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._names("manifests") if n.startswith("m") and n.endswith(".json"))

    def _listed(self, number: int) -> list[Run]:
        stream = self._files.open(self._path(f"manifests/m{number:010d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Run(**r) for r in json.loads(text)]

    def runs(self) -> list[Run]:
        """The runs of the state as it is, the oldest first."""
        numbers = self._manifests()
        return self._listed(numbers[-1]) if numbers else []

    @property
    def batch(self) -> int | None:
        """The last batch that is in the state."""
        runs = self.runs()
        return runs[-1].high if runs else None

    def _commit(self, runs: list[Run]) -> None:
        numbers = self._manifests()
        number = numbers[-1] + 1 if numbers else 0
        whole, part = self._path(f"manifests/m{number:010d}.json"), self._path(f"manifests/.{uuid.uuid4().hex}")
        out = self._files.create(part, True)
        try:
            out.write(bytearray(json.dumps([asdict(r) for r in runs]).encode()))
        finally:
            out.close()
        if not self._files.rename(part, whole):
            raise RuntimeError(f"manifest {number} of {self.folder} exists: another writer is at work")
        numbers.append(number)
        named = {r.name for k in numbers[-KEEP:] for r in self._listed(k)}
        for old in numbers[:-KEEP]:
            self._files.delete(self._path(f"manifests/m{old:010d}.json"), False)
        for name in self._names("runs"):
            if name not in named:
                self._files.delete(self._path(f"runs/{name}"), True)

    def _read(self, runs: list[Run]) -> DataFrame:
        """The rows of some runs, and `run`."""
        out = self.spark.createDataFrame([], self.schema).withColumn("run", F.lit(0).cast("long"))
        for r in runs:
            out = out.unionByName(self.spark.read.schema(self.schema).parquet(f"{self.folder}/runs/{r.name}").withColumn("run", F.lit(r.high).cast("long")))
        return out

    def read(self, only: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """The state; or of the rows that `only` keeps, which must keep or drop all rows that are merged into one."""
        rows = self._read(self.runs())
        return self.merge(only(rows) if only else rows, True)

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        writer = rows.select(*self.schema.names).write
        (writer.partitionBy(*self.by) if self.by else writer).parquet(f"{self.folder}/runs/{name}")
        return name

    def append(self, rows: DataFrame, batch: int) -> bool:
        """Add a batch's rows; False where the state has that batch. Fit for foreachBatch."""
        runs = self.runs()
        if runs and runs[-1].high >= batch:
            return False
        name = self._write(rows)
        runs = [*runs, Run(batch, batch, 0, name)]
        while len(tail := runs[-self.fan :]) == self.fan and len({r.level for r in tail}) == 1:
            whole = len(runs) == self.fan
            merged = self._write(self.merge(self._read(tail), whole))
            runs = [*runs[: -self.fan], Run(tail[0].low, tail[-1].high, tail[0].level + 1, merged)]
        self._commit(runs)
        return True

    def compact(self) -> None:
        """Merge all runs into one."""
        runs = self.runs()
        if len(runs) > 1:
            name = self._write(self.merge(self._read(runs), True))
            self._commit([Run(runs[0].low, runs[-1].high, max(r.level for r in runs) + 1, name)])
