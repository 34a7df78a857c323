"""Tables under one manifest: changes of several tables become visible together.

Each change writes new Parquet folders and then one manifest that names the
folders of every table.  A job that is lost before that leaves the tables as
they were.  Tables with keys lie in hash buckets, so that a change rewrites
only the buckets it touches; tables without keys only grow by folders.
One writer at a time: a second one finds its base manifest outdated and fails.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from copy import deepcopy

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a new table, and rows of a bucket that ``compact`` aims at.
BUCKETS, BUCKET_ROWS = 4, 1_000_000
#: Folders of a bucket from which ``maintain`` compacts the table.
MOST_FOLDERS = 16


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder that the session names for checkpoints; in one process, without it, on this machine."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = context._jsc.sc().getCheckpointDir()
        if not found.isDefined() and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = found.get() if found.isDefined() else tempfile.mkdtemp()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Conflict(RuntimeError):
    """Another writer has changed the tables meanwhile."""


class Store:
    def __init__(self, spark: SparkSession, root: str, *, bucket_rows: int = BUCKET_ROWS) -> None:
        self.spark, self.root, self.bucket_rows = spark, root.rstrip("/"), bucket_rows

    # ---- files -------------------------------------------------------------------

    def _path(self, *parts: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, *parts: str) -> list[str]:
        fs, path = self._path(*parts)
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def _manifests(self) -> list[int]:
        return [int(n[2:-5]) for n in self._names("manifests") if n.startswith("m-") and n.endswith(".json")]

    def _load(self, number: int) -> dict:
        fs, path = self._path("manifests", f"m-{number:010d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self) -> dict:
        """The tables as they are now: {number, tables: {name: {keys, buckets, parts, schema, changed}}}."""
        found = self._manifests()
        return self._load(found[-1]) if found else {"number": 0, "tables": {}}

    def _swap(self, manifest: dict) -> None:
        number = manifest["number"]
        fs, draft = self._path("manifests", f".draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode("utf-8")))
        out.close()
        _, final = self._path("manifests", f"m-{number:010d}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise Conflict(f"manifest {number} is there already")

    # ---- reading -----------------------------------------------------------------

    def version(self, name: str) -> int:
        """The number of the manifest that changed the table last; 0 without the table."""
        return self.manifest()["tables"].get(name, {}).get("changed", 0)

    def read(self, name: str, like: DataFrame | None = None) -> DataFrame | None:
        """The table, or of it the buckets that the keys of ``like`` fall into."""
        entry = self.manifest()["tables"].get(name)
        if entry is None:
            return None
        return self.of(entry, None if like is None else touched(like, entry))

    def of(self, entry: dict, buckets: set[int] | None = None) -> DataFrame:
        parts = [f"{self.root}/{p}" for b, ps in sorted(entry["parts"].items()) if buckets is None or int(b) in buckets for p in ps]
        shape = StructType.fromJson(entry["schema"])
        return self.spark.read.schema(shape).parquet(*parts) if parts else self.spark.createDataFrame([], shape)

    # ---- changing ----------------------------------------------------------------

    def change(self) -> Change:
        return Change(self)

    def write(self, name: str, df: DataFrame, keys: list[str] | None = None) -> None:
        change = self.change()
        change.replace(name, df, keys)
        change.commit()

    def compact(self, *names: str) -> None:
        """Rewrite tables with one folder in each bucket, and as many buckets as their rows need."""
        change = self.change()
        for name in names:
            entry = change.tables[name]
            df = self.of(entry)
            change.replace(name, df, entry["keys"], buckets=max(BUCKETS, -(-df.count() // self.bucket_rows)) if entry["keys"] else 1)
        change.commit()

    def maintain(self, most: int = MOST_FOLDERS) -> list[str]:
        """Compact the tables one of whose buckets lies in more than ``most`` folders, then vacuum; their names."""
        names = [n for n, e in self.manifest()["tables"].items() if max(map(len, e["parts"].values()), default=0) > most]
        if names:
            self.compact(*names)
        self.vacuum()
        return names

    def vacuum(self, keep: int = 2) -> int:
        """Delete all manifests but the last ``keep``, and folders that none of these names; the number of folders."""
        numbers = self._manifests()
        live = {p.split("/")[1] for n in numbers[-keep:] for e in self._load(n)["tables"].values() for ps in e["parts"].values() for p in ps}
        gone = [n for n in self._names("data") if n not in live]
        for n in numbers[:-keep]:
            fs, path = self._path("manifests", f"m-{n:010d}.json")
            fs.delete(path, False)
        for n in gone:
            fs, path = self._path("data", n)
            fs.delete(path, True)
        return len(gone)


def bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int") if keys else F.lit(0)


def touched(rows: DataFrame, entry: dict) -> set[int]:
    """The buckets of the rows' keys; there are never more of them than buckets."""
    if not entry["keys"]:
        return {0}
    return {r[0] for r in rows.select(bucket(entry["keys"], entry["buckets"]).alias("b")).distinct().collect()}


class Change:
    """Changes of several tables that ``commit`` makes visible at once.  Rows that are given twice should be settled before."""

    def __init__(self, store: Store) -> None:
        self.store = store
        base = store.manifest()
        self.number, self.tables = base["number"] + 1, deepcopy(base["tables"])

    def _put(self, entry: dict, df: DataFrame) -> dict[str, list[str]]:
        """Write rows to a new folder; the folder of each bucket that has any."""
        name = f"data/{uuid.uuid4().hex}"
        if entry["keys"]:
            tagged = df.withColumn("__b", bucket(entry["keys"], entry["buckets"]))
            tagged.repartition(entry["buckets"], "__b").write.partitionBy("__b").parquet(f"{self.store.root}/{name}")
            return {n[4:]: [f"{name}/{n}"] for n in self.store._names(name) if n.startswith("__b=")}
        df.write.parquet(f"{self.store.root}/{name}")
        return {"0": [name]}

    def _entry(self, name: str, df: DataFrame, keys: list[str] | None) -> dict:
        """The table's entry, made if it is new; columns that are new to it are added, and null in its older rows."""
        entry = self.tables.setdefault(name, {"keys": list(keys or []), "buckets": BUCKETS if keys else 1, "parts": {}, "schema": {"type": "struct", "fields": []}})
        known = {f["name"] for f in entry["schema"]["fields"]}
        entry["schema"]["fields"] += [f | {"nullable": True} for f in json.loads(df.schema.json())["fields"] if f["name"] not in known]
        entry["changed"] = self.number
        return entry

    def replace(self, name: str, df: DataFrame, keys: list[str] | None = None, *, buckets: int | None = None) -> None:
        old = self.tables.pop(name, None)
        entry = self._entry(name, df, old["keys"] if keys is None and old else keys)
        entry["buckets"] = buckets or (old["buckets"] if old and old["keys"] == entry["keys"] else entry["buckets"])
        entry["parts"] = self._put(entry, df)

    def append(self, name: str, df: DataFrame, keys: list[str] | None = None) -> None:
        """Rows beside those that are there."""
        entry = self._entry(name, df, keys)
        for b, ps in self._put(entry, df).items():
            entry["parts"].setdefault(b, []).extend(ps)

    def insert(self, name: str, df: DataFrame, on: list[str], keys: list[str] | None = None) -> None:
        """Append of the rows whose ``on`` is not there, one for each; only the buckets they fall into are read."""
        if name in self.tables:
            entry = self.tables[name]
            df = df.dropDuplicates(on).join(self.store.of(entry, touched(df, entry)).select(*on), on, "left_anti").select(*df.columns)
            self.append(name, df)
        else:
            self.append(name, df.dropDuplicates(on), keys)

    def upsert(self, name: str, df: DataFrame, on: list[str], *, deletes: DataFrame | None = None, keys: list[str] | None = None) -> None:
        """Rows in place of those with the same ``on``; rows that agree with ``deletes`` in all its columns go.

        Only the buckets of both are rewritten.  ``on`` and the columns of
        ``deletes`` must hold the table's keys.
        """
        if name not in self.tables:
            return self.append(name, df, keys)
        entry = self._entry(name, df, keys)
        own = touched(df, entry) | (touched(deletes, entry) if deletes is not None else set())
        rest = self.store.of(entry, own).join(df.select(*on).distinct(), on, "left_anti")
        if deletes is not None:
            rest = rest.join(deletes.distinct(), deletes.columns, "left_anti")
        written = self._put(entry, rest.unionByName(df, allowMissingColumns=True))
        for b in own:
            entry["parts"].pop(str(b), None)
        entry["parts"].update(written)

    def commit(self) -> int:
        self.store._swap({"number": self.number, "tables": self.tables})
        return self.number
