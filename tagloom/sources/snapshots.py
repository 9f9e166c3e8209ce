"""Tables that are replaced whole, by partition or by range, in one step that readers see or don't see.

A version is a folder of its own with a manifest: which folders hold the rows, and the values of each one's
partition. Its commit is one empty file in ``_versions`` whose name says its number and its folder; making
that file is the only step that changes what readers see. Rows, manifest and marker are written in this
order, so a step that fails leaves the last version as it was, and old versions can still be read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.sources.sinks import _files


class Conflict(RuntimeError):
    """Another writer committed the same version first."""


class Snapshot:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # -- what is there

    def _names(self, folder: str) -> list[str]:
        place, files = _files(self.spark, f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in files.listStatus(place)) if files.exists(place) else []

    def versions(self) -> dict[int, str]:
        """The folder of each version; of two writers' markers for one number the first by name counts."""
        found: dict[int, str] = {}
        for name in self._names("_versions"):
            number, _, folder = name.partition("-")
            found.setdefault(int(number), folder)
        return found

    def version(self) -> int:
        """The number of the last version, 0 before the first."""
        return max(self.versions(), default=0)

    def _manifest(self, version: int | None) -> dict:
        known = self.versions()
        version = version or max(known, default=0)
        if version not in known:
            raise FileNotFoundError(f"{self.path} has no version {version or ''}")
        text = self.spark.read.text(f"{self.path}/{known[version]}/manifest", wholetext=True)
        return json.loads(text.first()[0])

    def read(self, version: int | None = None, **partition: object) -> DataFrame:
        """The rows of the last version or of an older one; of some partitions, where their columns' values are given (a value or a list of them)."""
        manifest = self._manifest(version)
        wanted = {k: {str(x) for x in (v if isinstance(v, (list, tuple, set)) else [v])} for k, v in partition.items()}
        if unknown := wanted.keys() - set(manifest["by"]):
            raise ValueError(f"not partitioned by {', '.join(sorted(unknown))}")
        paths = [f"{self.path}/{p['folder']}" for p in manifest["parts"] if all(p["values"][manifest["by"].index(k)] in v for k, v in wanted.items())]
        if not paths:
            return self.spark.createDataFrame([], manifest["schema"])
        return self.spark.read.schema(manifest["schema"]).parquet(*paths)

    # -- how it changes

    def _write(self, rows: DataFrame, by: tuple[str, ...]) -> tuple[str, list[dict]]:
        """The rows in a folder of their own, one below for each partition; columns stay in the files."""
        folder = f"data/{uuid.uuid4().hex}"
        place = f"{self.path}/{folder}"
        if not by:
            rows.write.parquet(f"{place}/rows")
            return folder, [{"folder": f"{folder}/rows", "values": []}]
        keys = [f"_by{i}" for i in range(len(by))]
        rows.withColumns({k: F.hex(F.encode(F.col(c).cast("string"), "utf-8")) for k, c in zip(keys, by)}).write.partitionBy(*keys).parquet(f"{place}/rows")
        parts, level = [], [(f"{folder}/rows", [])]
        for _ in by:
            level = [(f"{f}/{n}", [*v, n.partition("=")[2]]) for f, v in level for n in self._names(f) if n.startswith("_by")]
        for f, values in level:
            parts.append({"folder": f, "values": [None if v == "__HIVE_DEFAULT_PARTITION__" else bytes.fromhex(v).decode() for v in values]})
        return folder, parts

    def _commit(self, schema: str, by: tuple[str, ...], parts: list[dict], after: int) -> int:
        folder = uuid.uuid4().hex
        manifest = json.dumps({"schema": schema, "by": by, "parts": parts})
        self.spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{self.path}/{folder}/manifest", lineSep="\n")
        self._mark(after + 1, folder)
        return after + 1

    def _mark(self, number: int, folder: str) -> None:
        name = f"{number:012d}-{folder}"
        marker, files = _files(self.spark, f"{self.path}/_versions/{name}")
        files.create(marker, False).close()
        if self.versions()[number] != folder:  # another writer's name comes first, and every reader sees that alike
            files.delete(marker, False)
            raise Conflict(f"version {number} of {self.path} is another writer's")

    @staticmethod
    def _schema(rows: DataFrame) -> str:
        return ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)

    def replace(self, rows: DataFrame, *by: str, after: int | None = None) -> int:
        """A version with ``rows`` alone, partitioned by ``by``; its number. ``after`` is the version that it follows, by default the last."""
        after = self.version() if after is None else after
        _, parts = self._write(rows, by)
        return self._commit(self._schema(rows), by, parts, after)

    def upsert(self, rows: DataFrame, *by: str) -> int:
        """A version in which the partitions that ``rows`` has are those of ``rows``, and the others as they were."""
        after = self.version()
        if not after:
            return self.replace(rows, *by, after=after)
        old = self._manifest(after)
        if tuple(old["by"]) != by or old["schema"] != self._schema(rows):
            raise ValueError(f"the table has {old['schema']}, partitioned by {old['by']}")
        _, parts = self._write(rows, by)
        fresh = {tuple(p["values"]) for p in parts}
        return self._commit(old["schema"], by, parts + [p for p in old["parts"] if tuple(p["values"]) not in fresh], after)

    def replace_range(self, rows: DataFrame, inside: Column) -> int:
        """A version without the rows where ``inside`` holds (not where it is null), and with ``rows``."""
        after = self.version()
        old = self._manifest(after)
        kept = self.read(after).where(~F.coalesce(inside, F.lit(False)))
        return self.replace(kept.unionByName(rows), *old["by"], after=after)

    def expire(self, keep: int = 2) -> int:
        """Deletes the markers of all but the last ``keep`` versions, then what no version names; how many folders went. Not beside a writer."""
        known = self.versions()
        stay = sorted(known)[-keep:]
        used = {p["folder"].split("/")[1] for n in stay for p in self._manifest(n)["parts"]}
        for name in self._names("_versions"):
            if int(name.partition("-")[0]) not in stay:
                place, files = _files(self.spark, f"{self.path}/_versions/{name}")
                files.delete(place, False)
        gone = [f"data/{n}" for n in self._names("data") if n not in used] + [f for n, f in known.items() if n not in stay]
        for folder in gone:
            place, files = _files(self.spark, f"{self.path}/{folder}")
            files.delete(place, True)
        return len(gone)
