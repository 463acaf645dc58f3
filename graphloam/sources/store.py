"""A graph store: Parquet in a folder, one version of one graph in each subfolder."""

from __future__ import annotations

import json
import urllib.parse
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import IdConflictError, collisions, merge, union
from ..operators.select import match, remove_skeleton
from ..schema import ASSERTIONS, NODES, Graph

VERSION = 1


class StoreError(Exception):
    """The store can't do that."""


class UnknownVersion(StoreError):
    """Written by a later version."""


class Store:
    """put, get, drop, names, match, add and remove. A put writes a new version beside the old one and then moves the pointer file, so readers never see half of one; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        conf = spark._jsc.hadoopConfiguration()
        self._path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        self.fs = self._path(self.path).getFileSystem(conf)
        meta = self._read(f"{self.path}/meta.json")
        if meta is None:
            self._write(f"{self.path}/meta.json", json.dumps({"version": VERSION}))
        elif json.loads(meta)["version"] > VERSION:
            raise UnknownVersion(meta)

    def _read(self, path: str) -> str | None:
        if not self.fs.exists(self._path(path)):
            return None
        return "\n".join(r.value for r in self.spark.read.text(path).collect())

    def _write(self, path: str, text: str) -> None:
        draft = self._path(f"{path}.{uuid.uuid4().hex}")
        out = self.fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.delete(self._path(path), False)
        self.fs.rename(draft, self._path(path))

    def _folder(self, name: str) -> str:
        return f"{self.path}/{urllib.parse.quote(name, safe='')}"

    def names(self) -> list[str]:
        found = (s.getPath().getName() for s in self.fs.listStatus(self._path(self.path)) if s.isDirectory())
        return sorted(urllib.parse.unquote(n) for n in found)

    def get(self, name: str) -> Graph:
        current = self._read(f"{self._folder(name)}/current")
        if current is None:
            raise KeyError(name)
        at = f"{self._folder(name)}/{current}"
        return Graph(self.spark.read.schema(NODES).parquet(f"{at}/nodes"), self.spark.read.schema(ASSERTIONS).parquet(f"{at}/assertions"))

    def put(self, name: str, g: Graph, merge_in: bool = True, normalize: bool = True) -> None:
        """Write ``g`` under ``name``: united with what is there, or instead of it; rows are clustered by root for lookups."""
        renamed = Graph(g.nodes.withColumn("graph", F.lit(name)).select("graph", "id", "types"), g.assertions.withColumn("graph", F.lit(name)))
        united = merge_in and name in self.names()
        merged = united or normalize
        if united:
            renamed = union(self.get(name), renamed)
        else:
            bad = collisions(renamed).limit(1).collect()
            if bad:
                raise IdConflictError(bad[0].id)
            renamed = merge(renamed) if normalize else renamed
        version = uuid.uuid4().hex
        at = f"{self._folder(name)}/{version}"
        renamed.nodes.write.parquet(f"{at}/nodes")
        placed = renamed.assertions if merged else renamed.assertions.repartition("root")
        placed.sortWithinPartitions("root", "label").write.parquet(f"{at}/assertions")
        old = self._read(f"{self._folder(name)}/current")
        self._write(f"{self._folder(name)}/current", version)
        if old:
            self.fs.delete(self._path(f"{self._folder(name)}/{old}"), True)

    def drop(self, name: str) -> None:
        if name not in self.names():
            raise KeyError(name)
        self.fs.delete(self._path(self._folder(name)), True)

    def match(self, name: str, origin: str | None = None, label: str | None = None) -> DataFrame:
        """As in :func:`match`; an unknown graph has no rows."""
        none = Graph(self.spark.createDataFrame([], NODES), self.spark.createDataFrame([], ASSERTIONS))
        return match(self.get(name) if name in self.names() else none, origin, label)

    def add(self, name: str, origin: str, label: str, payload: str, kind: str = "P", interp: str | None = None, id_: str | None = None) -> None:
        if name in self.names() and not self.get(name).assertions.where(F.col("id") == origin).isEmpty():
            raise StoreError("the origin is an assertion")
        row = (name, uuid.uuid4().hex, None, origin, 0, kind, origin, label, payload if kind == "E" else None, payload if kind == "P" else None, id_, interp)
        nodes = [(name, origin, [])] + ([(name, payload, [])] if kind == "E" else [])
        self.put(name, Graph(self.spark.createDataFrame(nodes, NODES), self.spark.createDataFrame([row], ASSERTIONS)))

    def remove(self, name: str, origin: str, label: str, payload: str) -> None:
        """Anonymous rows of this skeleton and all below; an unknown graph is left at that."""
        if name in self.names():
            self.put(name, remove_skeleton(self.get(name), origin, label, payload), merge_in=False)


def open_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path)
