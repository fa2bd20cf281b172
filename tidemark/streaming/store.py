"""The live table: day folders that only merges touching them write anew, under versions that appear at once.

A version is a manifest: for each day the folder that holds its rows. A merge writes the days it touches into a
new folder, drafts a manifest that names it beside the untouched days' folders, and renames the draft to
the next version's name, which fails if that version exists. Whatever a crash interrupts, the table is
the version before or the one after; what a crash left behind is removed with old versions.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.panel import K, settled

DAY = "__day"
#: The folder of rows without a time.
NO_DAY = "none"
VERSION = re.compile(r"v(\d{12})\.json")
#: The most files that a day of a merge is written in.
FILES = 8


def day() -> Column:
    return F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit(NO_DAY))


class Conflict(Exception):
    """Another merge has taken the next version."""


class Files:
    """The shared folder's files as Spark's own readers and writers see them."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        conf = spark._jsc.hadoopConfiguration()
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        self.system = at.getFileSystem(conf)
        self.root = self.system.makeQualified(at).toString()
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.system.getUri(), conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def names(self, folder: str) -> list[str]:
        at = self.at(folder)
        return sorted(f.getPath().getName() for f in self.system.listStatus(at)) if self.system.exists(at) else []

    def text(self, name: str) -> str:
        stream = self.system.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        stream = self.system.create(self.at(name), False)
        stream.writeBytes(text)  # ASCII
        stream.close()

    def rename(self, old: str, new: str) -> None:
        """Atomic; a file of the new name is never replaced."""
        none = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        self.system.mkdirs(self.at(new).getParent())
        try:
            self.context.rename(self.at(old), self.at(new), none)
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                raise Conflict(new) from None
            raise

    def remove(self, name: str) -> None:
        self.system.delete(self.at(name), True)


class LiveTable:
    """A table of (panel_id, channel, ts, ...) that merges add to, crash by crash whole.

    ``keep``: how many versions stay readable. Rows without a time have a folder of their own.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 10):
        self.spark, self.keep = spark, max(keep, 1)
        self.files = Files(spark, path.rstrip("/"))

    # -------------------------------------------------------------- versions
    def versions(self) -> list[int]:
        """The versions that can be read, oldest first."""
        return [int(m[1]) for m in map(VERSION.fullmatch, self.files.names("versions")) if m]

    def _manifest(self, version: int | None = None) -> dict | None:
        known = self.versions()
        if version is None:
            version = known[-1] if known else None
        elif version not in known:
            raise ValueError(f"no version {version}; there are {known}")
        return None if version is None else json.loads(self.files.text(f"versions/v{version:012}.json"))

    def read(self, version: int | None = None, since: str | None = None, until: str | None = None) -> DataFrame | None:
        """The newest version, or ``version``; only the days from ``since`` to ``until`` (yyyy-MM-dd), if given. None before the first merge."""
        told = self._manifest(version)
        if told is None:
            return None
        return self._rows(told, [d for d in told["days"] if (since is None or d >= since) and (until is None or d <= until)])

    def _rows(self, told: dict, days: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(told["schema"])
        paths = [f"{self.files.root}/{told['days'][d]}/{DAY}={d}" for d in days if d in told["days"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # -------------------------------------------------------------- changes
    def _step(self, name: str) -> None:
        """Called between any two steps of a change."""

    def _publish(self, told: dict | None, rows: DataFrame, touched: list[str] | None) -> int:
        """The next version: ``rows`` instead of the days ``touched`` (None: of all days)."""
        version = told["version"] + 1 if told else 0
        folder = f"data/v{version:012}-{uuid.uuid4().hex}"
        dealt = rows.withColumn(DAY, day()).repartition(DAY, F.pmod(F.hash(*K), F.lit(FILES)))
        dealt.write.partitionBy(DAY).parquet(f"{self.files.root}/{folder}")
        self._step("written")
        written = [n.split("=", 1)[1] for n in self.files.names(folder) if n.startswith(f"{DAY}=")]
        if touched is not None and not set(written) <= set(touched):
            raise ValueError(f"a merge gave rows of days that it did not read: {sorted(set(written) - set(touched))}")
        left = {d: at for d, at in (told["days"] if told else {}).items() if touched is not None and d not in touched}
        manifest = {"version": version, "schema": rows.schema.jsonValue(), "days": left | {d: folder for d in written}}
        draft = f"drafts/{uuid.uuid4().hex}.json"
        self.files.put(draft, json.dumps(manifest))
        self._step("drafted")
        self.files.rename(draft, f"versions/v{version:012}.json")
        self._step("committed")
        return version

    def merge(self, batch: DataFrame, how: Callable[[DataFrame, DataFrame | None], DataFrame] | None = None, tries: int = 5) -> int | None:
        """Merges ``batch`` by ``how`` (``upsert_live`` by default; batch, live rows of its days -> their new
        rows) and returns the version that holds it; None for an empty batch.

        Only the batch's days are read and written. A merge that finds its version taken starts again from that one.
        """
        from .live import upsert_live

        own = f"drafts/batch-{uuid.uuid4().hex}"  # read twice; gone when the merge is
        batch.write.parquet(f"{self.files.root}/{own}")
        try:
            version = self._merged(self.spark.read.schema(batch.schema).parquet(f"{self.files.root}/{own}"), how or upsert_live, tries)
        finally:
            self.files.remove(own)
        if version is None:
            return None
        self.vacuum()
        self._step("vacuumed")
        return version

    def _merged(self, batch: DataFrame, how: Callable[[DataFrame, DataFrame | None], DataFrame], tries: int) -> int | None:
        days = sorted(r[0] for r in batch.select(day()).distinct().collect())
        self._step("settled")
        if not days:
            return None
        for left in reversed(range(tries)):
            told = self._manifest()
            live = self._rows(told, days) if told else None
            self._step("read")
            try:
                return self._publish(told, how(batch, live), days)
            except Conflict:
                if not left:
                    raise
        return None

    def replace(self, rows: DataFrame) -> int:
        """A new version that holds ``rows`` alone."""
        version = self._publish(self._manifest(), settled(rows, "rows"), None)
        self.vacuum()
        return version

    def bootstrap(self, baseline: DataFrame | None, behind: int = 3600) -> bool:
        """Whether any panel had to take the baseline's rows (see ``choose_live_base``); untouched otherwise."""
        from .live import choose_live_base, renewed

        live = self.read()
        if live is not None and (baseline is None or renewed(live, baseline, behind).where("__renew").isEmpty()):
            return False
        self.replace(choose_live_base(live, baseline, behind))
        return True

    def vacuum(self) -> None:
        """Removes all versions but the last ``keep``, and folders and drafts that none of these names.

        Folders of a version after the newest are of a merge under way and stay.
        """
        known = self.versions()
        for v in known[: -self.keep]:
            self.files.remove(f"versions/v{v:012}.json")
        self._step("forgotten")
        used = {f for v in known[-self.keep :] for f in self._manifest(v)["days"].values()}
        newest = known[-1] if known else -1
        for name in self.files.names("data"):
            if f"data/{name}" not in used and int(name[1:13]) <= newest:
                self.files.remove(f"data/{name}")

    def follow(self, stream: DataFrame, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None):
        """Merges every micro-batch of ``stream``; ``on_batch`` sees the live table after it. A batch that comes
        again after a crash changes nothing."""

        def step(batch: DataFrame, number: int) -> None:
            self.merge(batch)
            if on_batch:
                on_batch(self.read(), number)

        return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
