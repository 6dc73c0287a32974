"""Tables that can be changed: immutable Parquet segments, and a catalogue that says which of them a table is.

Changes are copy on write: a segment that holds no changed row is kept as it is, the others are written anew, and the
catalogue is replaced by a rename. Added, renamed and dropped columns change only the catalogue: a segment remembers
the name that it has for a column, or that it has none and the column's default holds.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .readers import lay_out


class Store:
    def __init__(self, spark: SparkSession, root: str, create: bool = False):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if create and not self._fs.exists(self._path(f"{self.root}/catalog.json")):
            self._fs.mkdirs(self._path(self.root))
            self._save({"tables": {}})
        self.refresh()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def refresh(self) -> None:
        held = self._held()
        self.tables: dict[str, dict] = held["tables"]
        self.version = held.get("version", 0)

    def _held(self) -> dict:
        """The catalogue as it is now."""
        stream = self._fs.open(self._path(f"{self.root}/catalog.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _save(self, catalog: dict | None = None) -> None:
        """A change made elsewhere since this catalogue was read is an error, not overwritten. Each version is claimed by
        creating its own file, which only one writer can."""
        if catalog is None:
            if (now := self._held().get("version", 0)) != self.version:
                self.refresh()
                raise RuntimeError(f"the catalogue changed meanwhile (version {now}); the change was not made")
            claim = self._path(f"{self.root}/.claim-{self.version + 1}")
            if not self._fs.createNewFile(claim):
                raise RuntimeError(f"version {self.version + 1} of the catalogue is being written by another; the change was not made")
            self._fs.delete(self._path(f"{self.root}/.claim-{self.version}"), False)
            self.version += 1
        new = f"{self.root}/.catalog-{uuid.uuid4().hex}"
        out = self._fs.create(self._path(new))
        out.write(bytearray(json.dumps(catalog or {"tables": self.tables, "version": self.version}).encode()))
        out.close()
        target = self._path(f"{self.root}/catalog.json")
        if not self._fs.rename(self._path(new), target):  # some file systems don't rename onto a file
            self._fs.delete(target, False)
            if not self._fs.rename(self._path(new), target):
                raise OSError(f"the catalogue could not be replaced: {target}")

    def _table(self, name: str) -> dict:
        if name not in self.tables:
            raise KeyError(f"no table {name}")
        return self.tables[name]

    # definitions

    def create(self, name: str, columns: list[tuple[str, str]], defaults: dict[str, str] | None = None) -> None:
        if name in self.tables:
            raise ValueError(f"table {name} exists")
        self.tables[name] = {"columns": [list(c) for c in columns], "defaults": defaults or {}, "segments": [], "mode": "segment"}
        self._save()

    def drop(self, name: str, if_exists: bool = False) -> None:
        """From the catalogue; its files stay until vacuum()."""
        if name not in self.tables and if_exists:
            return
        self._table(name)
        del self.tables[name]
        self._save()

    def add_column(self, name: str, column: str, kind: str, default: str | None = None) -> None:
        t = self._table(name)
        if column in dict(t["columns"]):
            raise ValueError(f"column {column} exists")
        t["columns"].append([column, kind])
        if default is not None:
            t["defaults"][column] = default
        self._save()

    def rename_column(self, name: str, old: str, new: str) -> None:
        t = self._table(name)
        if old not in dict(t["columns"]) or new in dict(t["columns"]):
            raise ValueError(f"can't rename {old} to {new}")
        t["columns"] = [[new if c == old else c, k] for c, k in t["columns"]]
        t["defaults"] = {new if c == old else c: v for c, v in t["defaults"].items()}
        for s in t["segments"]:
            s["names"] = {new if c == old else c: p for c, p in s["names"].items()}
        self._save()

    def drop_column(self, name: str, column: str) -> None:
        t = self._table(name)
        if column not in dict(t["columns"]) or len(t["columns"]) == 1:
            raise ValueError(f"can't drop {column}")
        t["columns"] = [c for c in t["columns"] if c[0] != column]
        t["defaults"].pop(column, None)
        for s in t["segments"]:
            s["names"].pop(column, None)
        self._save()

    def rename(self, name: str, new: str) -> None:
        if new in self.tables:
            raise ValueError(f"table {new} exists")
        self.tables[new] = self.tables.pop(name)
        self._save()

    def set_mode(self, name: str, mode: str) -> None:
        if mode not in ("segment", "buffered"):
            raise ValueError("mode is segment or buffered")
        self._table(name)["mode"] = mode
        self._save()

    # reading

    def read(self, name: str, segments: list[dict] | None = None) -> DataFrame:
        t = self._table(name)
        groups: dict[str, list[dict]] = {}
        for s in t["segments"] if segments is None else segments:
            groups.setdefault(json.dumps(s["names"], sort_keys=True), []).append(s)
        out = None
        for same in groups.values():
            names = same[0]["names"]
            df = self.spark.read.parquet(*[f"{self.root}/{s['path']}" for s in same])
            columns = [(F.col(f"`{names[c]}`") if c in names else F.expr(t["defaults"].get(c, "NULL"))).cast(k).alias(c) for c, k in t["columns"]]
            df = df.select(*columns, F.col("_metadata.file_path").alias("__file")) if segments is not None else df.select(*columns)
            out = df if out is None else out.unionByName(df)
        if out is None:
            out = self.spark.createDataFrame([], StructType.fromDDL(", ".join(f"`{c}` {k}" for c, k in t["columns"])))
        return out

    # changes

    def _write(self, name: str, df: DataFrame) -> dict:
        path = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{path}")
        return {"path": path, "names": {c: c for c in df.columns}}

    def append(self, name: str, df: DataFrame, columns: list[str] | None = None) -> int:
        """Columns by place; those not given take their defaults."""
        t = self._table(name)
        segment = self._write(name, self.fitted(name, df, columns))
        t["segments"].append(segment)
        self._save()
        return self.read(name, [segment]).count()

    def fitted(self, name: str, df: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """With the table's columns and types."""
        t = self._table(name)
        columns = columns or [c for c, _ in t["columns"]]
        if len(columns) != len(df.columns):
            raise ValueError(f"{len(df.columns)} values for {len(columns)} columns")
        given = dict(zip(columns, df.columns))
        if missing := set(columns) - set(dict(t["columns"])):
            raise ValueError(f"no columns {sorted(missing)}")
        picked = [(F.col(f"`{given[c]}`") if c in given else F.expr(t["defaults"].get(c, "NULL"))).cast(k).alias(c) for c, k in t["columns"]]
        return df.select(*picked)

    def _replace(self, name: str, hit, changed) -> int:
        """Rewrites the segments that hold rows for which `hit` is true, through changed(DataFrame)."""
        t = self._table(name)
        if not t["segments"]:
            return 0
        hits = self.read(name, t["segments"]).filter(hit).withColumn("__seg", F.regexp_extract("__file", r"/([^/]+)/[^/]+$", 1))
        counts = {r["__seg"]: r["n"] for r in hits.groupBy("__seg").agg(F.count("*").alias("n")).collect()}  # a row per segment
        old = [s for s in t["segments"] if s["path"] in counts]
        if old:
            new = self._write(name, changed(self.read(name, old).drop("__file")))
            t["segments"] = [s for s in t["segments"] if s["path"] not in counts] + [new]
            self._save()
        return sum(counts.values())

    def delete(self, name: str, where: str | None) -> int:
        """Rows for which the condition is true; where it is NULL they stay."""
        hit = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
        return self._replace(name, hit, lambda df: df.filter(~hit))

    def update(self, name: str, values: dict[str, str], where: str | None) -> int:
        """All right sides see the row as it was."""
        kinds = dict(self._table(name)["columns"])
        if unknown := set(values) - set(kinds):
            raise ValueError(f"no columns {sorted(unknown)}")
        hit = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
        new = lambda df: df.select(*[F.when(hit, F.expr(values[c]).cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])
        return self._replace(name, hit, new)

    # maintenance

    def compact(self, name: str, files: int | None = None, cluster_by: list[str] | None = None) -> int:
        """All segments become one; returns how many there were."""
        t = self._table(name)
        before = len(t["segments"])
        if before > 1 or cluster_by or files:
            t["segments"] = [self._write(name, lay_out(self.read(name), cluster_by, None, files))]
            self._save()
        return before

    def retype(self, name: str, casts: dict[str, str]) -> None:
        from .readers import cast_columns

        t = self._table(name)
        df = cast_columns(self.read(name), casts)
        t["segments"] = [self._write(name, df)]
        t["columns"] = [[c, dict(df.dtypes)[c]] for c, _ in t["columns"]]
        self._save()

    def vacuum(self) -> int:
        """Removes segments that no table has."""
        live = {s["path"] for t in self.tables.values() for s in t["segments"]}
        gone = [f.getPath() for f in self._fs.listStatus(self._path(self.root)) if f.isDirectory() and f.getPath().getName() not in live]
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)
