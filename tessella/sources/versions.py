"""Tables that are replaced whole, without a moment at which a reader finds none.

Each version is a folder of its own; a commit is a small file that is created under the version's number only if it is
not there, so of two writers who read the same version one wins and the other is told. Readers take the version of
the last commit. Files of old versions stay until `keep_last` removes them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was to be."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, options: dict[str, str] | None = None):
        """With options of the Parquet writer."""
        self.spark, self.path, self.options = spark, path.rstrip("/"), options or {}
        jvm = spark._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _commits(self) -> list[int]:
        folder = self._Path(f"{self.path}/_commits")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def version(self) -> int:
        """Number of the last commit, 0 before the first."""
        return max(self._commits(), default=0)

    def facts(self, version: int | None = None) -> dict:
        """What was committed with a version: the folders of its parts, and the writer's own facts."""
        version = self.version() if version is None else version
        if not version:
            return {"parts": {}, "facts": {}}
        stream = self.fs.open(self._Path(f"{self.path}/_commits/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, part: str = "rows", version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.facts(version)['parts'][part]}")

    def append(self, parts: dict[str, DataFrame], base: int | None = None, **facts) -> int:
        """As replace(), with the other parts of `base` kept where they are."""
        base = self.version() if base is None else base
        return self.replace(parts, base, self.facts(base)["parts"], **facts)

    def replace(self, parts: dict[str, DataFrame], base: int | None = None, kept: dict[str, str] | None = None, **facts) -> int:
        """Write all parts and commit them as the version after `base` (default: the last one). Raises Conflict if
        that version is there already; what was written for it is removed then."""
        base = self.version() if base is None else base
        folder, wanted = f"v{base + 1}-{uuid.uuid4().hex}", self._Path(f"{self.path}/_commits/{base + 1:012d}.json")
        for name, df in parts.items():
            df.write.options(**self.options).parquet(f"{self.path}/{folder}/{name}")
        told = json.dumps({"parts": (kept or {}) | {n: f"{folder}/{n}" for n in parts}, "facts": facts})
        draft = self._Path(f"{self.path}/_commits/.{folder}")
        out = self.fs.create(draft, False)
        out.write(told.encode())
        out.close()
        # a link to a whole file appears at once and never replaces another
        if not self._publish(draft, wanted):
            self.fs.delete(draft, False)
            self.fs.delete(self._Path(f"{self.path}/{folder}"), True)
            raise Conflict(f"version {base + 1} of {self.path} is there already")
        return base + 1

    def _publish(self, draft, wanted) -> bool:
        """Give a written draft its final name, if no other has it: by a hard link on local file systems, by the rename
        of the file system elsewhere, which refuses a name that is taken."""
        if self.fs.getUri().getScheme() == "file":
            import os

            a, b = (p.toUri().getPath() for p in (draft, wanted))
            try:
                os.link(a, b)
            except FileExistsError:
                return False
            self.fs.delete(draft, False)
            return True
        return self.fs.rename(draft, wanted)

    def keep_last(self, n: int) -> None:
        """Remove the folders and commits of all but the last n versions (readers of older ones must be done)."""
        commits = self._commits()
        used = {part.split("/")[0] for k in commits[-n:] for part in self.facts(k)["parts"].values()}
        for k in commits[:-n]:
            for folder in {part.split("/")[0] for part in self.facts(k)["parts"].values()} - used:
                self.fs.delete(self._Path(f"{self.path}/{folder}"), True)
            self.fs.delete(self._Path(f"{self.path}/_commits/{k:012d}.json"), False)
