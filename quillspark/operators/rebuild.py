"""Rebuilding an index beside the one in use: versioned tables, a copy that resumes, checks, and a flip no reader sees half of.

    <root>/versions/<version>/part=<k>/   points of one share of the ids, written by one job each
    <root>/live/<number>=<version>        empty files; the highest number names the version readers get

A share is a hash range of point ids, so shares are even however ids, documents or connectors are spread.  A copy
that broke off goes on with what an anti join finds missing.  Promoting creates one new file and fails if that file is
there, so of two promotions at once one loses; a reader resolves the version once, when it asks for the
table, and reads that version's files alone, whatever is promoted meanwhile.

Defined cases: an empty source gives an empty version; ids are unique in a source, a null id is not copied; a version that has
been promoted is not written again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.retrieval import knn
from quillspark.operators.upkeep import swap_faults

TOLERANCE = 0


class NotPromoted(RuntimeError):
    """Why a version stays beside the live one."""


class Index:
    def __init__(self, spark: SparkSession, root: str, schema: str, shares: int = 16):
        """schema: id bigint, embedding array<...> and payload columns."""
        self.spark, self.root, self.schema, self.shares = spark, root.rstrip("/"), schema, shares

    # -- files ---------------------------------------------------------------

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _names(self, path: str) -> list[str]:
        fs, where = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def _promotions(self) -> list[tuple[int, str]]:
        return sorted((int(n.split("=", 1)[0]), n.split("=", 1)[1]) for n in self._names(f"{self.root}/live"))

    # -- reading -------------------------------------------------------------

    def live_version(self) -> str | None:
        told = self._promotions()
        return told[-1][1] if told else None

    def read(self, version: str | None = None) -> DataFrame:
        """The points of a version, or of the live one; no rows before the first promotion."""
        version = version or self.live_version()
        if version is None or not self._names(f"{self.root}/versions/{version}"):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/versions/{version}")

    def versions(self) -> list[str]:
        return self._names(f"{self.root}/versions")

    # -- writing -------------------------------------------------------------

    def _share(self):
        return F.pmod(F.xxhash64("id"), F.lit(self.shares)).cast("int")

    def copy(self, source: DataFrame, version: str, embed: Callable[[DataFrame], DataFrame], leave_out: DataFrame | None = None) -> int:
        """Writes what `version` lacks of `source`, embedded anew, and says how many points the version should hold of it.

        `leave_out` (a table of connector_id) names connectors whose points are cut anew and come by `add`.
        A share is one job that commits as a whole; one that is there in part is completed.
        """
        if version in (v for _, v in self._promotions()):
            raise NotPromoted(f"{version} has been promoted and is not written again")
        wanted = source.where(F.col("id").isNotNull())
        if leave_out is not None:
            wanted = wanted.join(leave_out.select("connector_id").distinct(), "connector_id", "left_anti")
        for k in range(self.shares):
            held = self.read(version).where(self._share() == k) if f"part={k}" in self._names(f"{self.root}/versions/{version}") else None
            share = wanted.where(self._share() == k)
            missing = share if held is None else share.join(held.select("id"), "id", "left_anti")
            if held is None or not missing.isEmpty():
                self._append(embed(missing), version, f"part={k}")
        return wanted.count()

    def add(self, points: DataFrame, version: str) -> int:
        """Points of connectors that are cut anew; the same call again replaces them."""
        self._append(points, version, "part=new", "overwrite")
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/versions/{version}/part=new").count()

    def _append(self, points: DataFrame, version: str, part: str, mode: str = "append") -> None:
        columns = self.spark.createDataFrame([], self.schema).schema
        points.select(*(F.col(f.name).cast(f.dataType) for f in columns)).write.mode(mode).parquet(f"{self.root}/versions/{version}/{part}")

    # -- checking and flipping -----------------------------------------------

    def faults(self, version: str, expected: int, width: int) -> str | None:
        """Why a version must not go live: too few points, repeated ids, other width, or a search that finds nothing."""
        points = self.read(version)
        told = points.agg(F.count("*").alias("points"), F.count_distinct("id").alias("ids"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).first()
        if told["points"] != told["ids"]:
            return "repeated points"
        probe = points.orderBy("id").limit(1).select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
        found = knn(points.select("id", "embedding"), probe, 1).count() if told["points"] else 0
        one = told["low"] if told["low"] == told["high"] else -1
        row = self.spark.createDataFrame([(version, told["points"], expected, one, width, found)], "collection string, points bigint, expected bigint, width int, model_width int, found bigint")
        return swap_faults(row, TOLERANCE).first()["fault"]

    def promote(self, version: str, expected: int, width: int) -> None:
        """Makes `version` the live one if it passes; otherwise, or if another promotion comes first, the old one stays."""
        told = self._promotions()
        fault = self.faults(version, expected, width)
        if fault:
            raise NotPromoted(f"{version}: {fault}")
        self._flip(version, told[-1][0] + 1 if told else 1)

    def _flip(self, version: str, number: int) -> None:
        # Created under a name of its own number first: whoever makes the lock file of a number owns that promotion.
        fs, lock = self._fs(f"{self.root}/locks/{number:012d}")
        try:
            fs.create(lock, False).close()
        except Exception as e:
            raise NotPromoted(f"another version was promoted as number {number}") from e
        fs, where = self._fs(f"{self.root}/live/{number:012d}={version}")
        fs.create(where, False).close()

    def retire(self, keep: int = 2) -> list[str]:
        """Deletes versions that were live before the last `keep`; those never promoted stay."""
        order = list(dict.fromkeys(v for _, v in reversed(self._promotions())))
        gone = [v for v in order[keep:] if v in self.versions()]
        for version in gone:
            fs, where = self._fs(f"{self.root}/versions/{version}")
            fs.delete(where, True)
        return gone


def scroll(points: DataFrame, after: int | None, limit: int) -> DataFrame:
    """The page of points after a cursor, in the order of id; the last id of a page is the next cursor."""
    rest = points if after is None else points.where(F.col("id") > after)
    return rest.where(F.col("id").isNotNull()).orderBy("id").limit(limit)


def without_connector(points: DataFrame, connector_id: int) -> DataFrame:
    """Points after a connector is deleted: its own go, and those of none stay."""
    return points.where(~F.col("connector_id").eqNullSafe(F.lit(connector_id)))
