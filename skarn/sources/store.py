"""A document store over parquet tables: declared collections, upserts by key, filtered reads, aliases of rebuilt tables."""
from __future__ import annotations

import time
import uuid
import zlib
from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.functions.scoring import merged_moments, moments
from skarn.functions.text import is_store_id
from skarn.operators.filters import order, where_equal
from skarn.operators.ingest import last_by
from skarn.sources.shared import shared_path
from skarn.sources.versions import Taken, Versions


@dataclass(frozen=True)
class Collection:
    """name, schema (DDL), primary key, the attributes that may be filtered and sorted by, and those whose mean and deviation are kept."""

    name: str
    schema: str
    key: str
    filterable: tuple[str, ...] = ()
    sortable: tuple[str, ...] = ()
    measured: tuple[str, ...] = ()


#: Parts of a collection, by a hash of the key; a write makes new versions of the parts that it touches only.
PARTS = 64
#: Races that a write may lose before it gives up.
RETRIES = 20


class Store:
    """Collections under one folder.

    A write reads its rows once into a staging folder, puts new versions of the parts it touches into a folder of its own, and then
    a record that says where each part lies (see Versions). Readers see whole writes. Of two writers that meet, the later one
    starts again from the earlier one's record: parts that it doesn't share are taken over, the others are merged anew. So no write
    replaces what it has not read, and no folder is written twice.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.specs = spark, path.rstrip("/"), {}

    def _records(self, name: str) -> Versions:
        return Versions(self.spark, f"{self.path}/{name}/versions")

    def plan(self, specs: Sequence[Collection]) -> list[dict]:
        """What ensure would do for each collection: create it, add columns, change settings; an error if a column or the key would change."""
        out = []
        for s in specs:
            record = self._records(s.name).last()[1] or {}
            old = record.get("spec")
            plan = {"name": s.name, "create": old is None, "add_columns": [], "settings": {}}
            if old is not None:
                had, wanted = (dict(_fields(x)) for x in (old["schema"], s.schema))
                if old["key"] != s.key or any(wanted.get(c) != kind for c, kind in had.items()):
                    raise ValueError(f"{s.name} is declared otherwise: its key and columns stay")
                plan["add_columns"] = [c for c in wanted if c not in had]
                plan["settings"] = {k: {"from": old[k], "to": list(getattr(s, k))} for k in ("filterable", "sortable") if old[k] != list(getattr(s, k))}
            out.append(plan)
        return out

    def ensure(self, specs: Sequence[Collection]) -> list[dict]:
        """Declares collections and returns what changed. Declaring again changes nothing; new columns are null in old rows."""
        plans = self.plan(specs)
        for s, plan in zip(specs, plans, strict=True):
            if plan["create"] or plan["add_columns"] or plan["settings"]:
                own = {"schema": s.schema, "key": s.key, "filterable": list(s.filterable), "sortable": list(s.sortable)}
                self._commit(s.name, lambda record, own=own: record | {"spec": own})
            self.specs[s.name] = s
        return plans

    def _spec(self, name: str) -> Collection:
        if name not in self.specs:
            raise KeyError(f"unknown collection {name}")
        return self.specs[name]

    def _commit(self, name: str, change) -> int:
        """Records change(newest record) as the next version; starts again if another writer was first. None: nothing to do."""
        records = self._records(name)
        for _ in range(RETRIES):
            number, record = records.last()
            new = change(record or {})
            if new is None:
                return number
            try:
                records.commit(number + 1, new)
            except Taken:
                continue
            return number + 1
        raise RuntimeError(f"{name}: {RETRIES} writers were first")

    def _parts(self, name: str) -> dict[str, str]:
        return (self._records(name).last()[1] or {}).get("parts", {})

    def _load(self, name: str, parts: dict[str, str]) -> DataFrame:
        spec = self._spec(name)
        if not parts:
            return self.spark.createDataFrame([], spec.schema)
        return self.spark.read.schema(spec.schema).parquet(*[f"{self.path}/{name}/{v}/_part={p}" for p, v in parts.items()])

    def read(self, name: str) -> DataFrame:
        return self._load(name, self._parts(name))

    def _part(self, key: str) -> Column:
        return (F.crc32(F.col(key).cast("string").cast("binary")) % PARTS).cast("int")

    def _touched(self, rows: DataFrame, key: str) -> list[str]:
        return [str(r[0]) for r in rows.select(self._part(key)).distinct().collect()]  # PARTS at most

    def _replace(self, name: str, touched: Sequence[str], make) -> int:
        """Commits new versions of the touched parts: make(their old rows). Made again only if another writer has changed one of them."""
        key, made = self._spec(name).key, {}

        def change(record: dict) -> dict:
            parts = record.get("parts", {})
            old = {p: v for p, v in parts.items() if p in touched}
            if made.get("from") != old:
                folder = f"v-{uuid.uuid4().hex}"
                rows = make(self._load(name, old)).withColumn("_part", self._part(key))
                rows.repartition("_part").write.partitionBy("_part").parquet(f"{self.path}/{name}/{folder}")
                new = self.spark.read.schema(self._spec(name).schema).parquet(f"{self.path}/{name}/{folder}")
                there = self._touched(new, key)
                stats = {c: {str(r["part"]): [r["n"], r["mean"], r["m2"]] for r in moments(new.withColumn("part", self._part(key)), c, "part").collect()} for c in self._spec(name).measured}  # PARTS rows each
                made.update({"from": old, "parts": {p: folder for p in there}, "stats": stats})
            had = record.get("stats", {})
            stats = {c: {p: v for p, v in had.get(c, {}).items() if p not in touched} | own for c, own in made["stats"].items()}
            return record | {"parts": {p: v for p, v in parts.items() if p not in touched} | made["parts"], "stats": stats}

        return self._commit(name, change)

    def put(self, name: str, rows: DataFrame, gone: DataFrame | None = None) -> int:
        """Upserts by key; of rows with one key the last wins. A batch with a bad key writes nothing. Returns the version that holds it.

        gone: keys that are removed in the same version (a column of the key's name; a key that is put as well stays). The rows are evaluated once, into a staging folder.
        """
        spec = self._spec(name)
        columns = [c for c, _ in _fields(spec.schema)]
        staged = f"{self.path}/{name}/staged-{uuid.uuid4().hex}"
        rows.withColumns({c: F.lit(None) for c in columns if c not in rows.columns}).select(*columns).withColumn("_n", F.monotonically_increasing_id()).write.parquet(staged)
        try:
            new = self.spark.read.schema(f"{spec.schema}, _n long").parquet(staged)
            if not new.where(~F.coalesce(is_store_id(F.col(spec.key).cast("string")), F.lit(False))).isEmpty():
                raise ValueError(f"a row of {name} has no valid {spec.key}")
            keys = new.select(spec.key)
            if gone is not None:
                gone.select(spec.key).where(F.col(spec.key).isNotNull()).write.parquet(f"{staged}-gone")
                keys = keys.unionByName(self.spark.read.schema(keys.schema).parquet(f"{staged}-gone"))
            touched = self._touched(keys, spec.key)
            if not touched:
                return self._records(name).last()[0]
            new = last_by(new, [spec.key], ["_n"]).select(*columns)
            return self._replace(name, touched, lambda old: old.join(keys.distinct(), spec.key, "left_anti").select(*columns).unionByName(new))
        finally:
            self._delete(staged)
            self._delete(f"{staged}-gone")

    def barrier(self, name: str, version: int, seconds: float = 60) -> None:
        """Returns once readers see a version that a put has returned, and with it every earlier put."""
        end = time.monotonic() + seconds
        while self._records(name).last()[0] < version:
            if time.monotonic() > end:
                raise TimeoutError(f"{name} has no version {version}")
            time.sleep(0.2)

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _delete(self, path: str) -> None:
        fs, to = self._fs()
        fs.delete(to(path), True)

    def vacuum(self, name: str, keep: int = 1, older_than: float = 7 * 86400) -> list[str]:
        """Deletes folders that none of the newest ``keep`` records names and that are older than so many seconds, and older records.

        Younger folders may belong to a write or a read that still runs. Returns the names of what is gone.
        """
        fs, to = self._fs()
        records = self._records(name)
        kept = records.numbers()[-keep:]
        named = {v for n in kept for v in (records.read(n) or {}).get("parts", {}).values()} | set(self._parts(name).values())
        gone, now = [], time.time() * 1000
        for status in fs.listStatus(to(f"{self.path}/{name}")):
            folder = status.getPath().getName()
            if folder.startswith(("v-", "staged-")) and folder not in named and now - status.getModificationTime() >= older_than * 1000:
                self._delete(f"{self.path}/{name}/{folder}")
                gone.append(folder)
        last = records.last()
        if kept and last[1] is not None and records.read(kept[0]) is not None:
            records.drop_before(kept[0])
        return sorted(gone)

    def get(self, name: str, key: str) -> dict | None:
        parts = self._parts(name)
        own = str(zlib.crc32(str(key).encode()) % PARTS)  # only the key's part is read
        row = self._load(name, {p: v for p, v in parts.items() if p == own}).where(F.col(self._spec(name).key) == key).limit(1).collect()
        return row[0].asDict(recursive=True) if row else None

    def statistics(self, name: str, column: str) -> tuple[int, float | None, float | None]:
        """(n, mean, standard deviation) of a measured column: merged from what the newest record keeps of each part, without reading rows."""
        record = self._records(name).last()[1] or {}
        if column not in self._spec(name).measured:
            raise ValueError(f"{column} is not measured")
        return merged_moments(list(record.get("stats", {}).get(column, {}).values()))

    def _filtered(self, name: str, where: dict | None) -> DataFrame:
        spec = self._spec(name)
        for k in where or {}:
            if k not in (*spec.filterable, spec.key):
                raise ValueError(f"{k} is not filterable")
        return self.read(name).where(where_equal(where))

    def count(self, name: str, where: dict | None = None) -> int:
        return self._filtered(name, where).count()

    def list(self, name: str, where: dict | None = None, fields: Sequence[str] | None = None, sort: Sequence[str] = (), limit: int | None = None) -> DataFrame:
        """Filtered rows; sorted before they are limited, missing values last."""
        spec = self._spec(name)
        out = self._filtered(name, where)
        if sort:
            out = out.orderBy(*order(sort, (*spec.sortable, spec.key), spec.key))
        if limit is not None:
            out = out.limit(limit)
        return out.select(*[f for f in fields if f in out.columns]) if fields else out

    def remove(self, name: str, where: dict) -> int:
        """Removes what matches; a removal without a filter is refused."""
        if not where:
            raise ValueError("removing everything needs a filter")
        found = self._filtered(name, where)
        gone = found.count()
        if gone:
            self._replace(name, self._touched(found, self._spec(name).key), lambda old: old.where(~where_equal(where)))
        return gone


def _fields(schema: str) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in T.StructType.fromDDL(schema).fields]


#: Hosts that count as local.
LOCAL_HOSTS = ("localhost", "127.0.0.1", "::1", "0.0.0.0")


def guard_seed(target: str, force: bool = False) -> None:
    """Refuses to write generated documents to a target (path or url) that isn't on this machine, unless forced."""
    url = urlsplit(target)
    local = url.scheme in ("", "file") or (url.hostname or "") in LOCAL_HOSTS
    if not (force or local):
        raise ValueError(f"generated documents don't go to {target}, which isn't local; force it if it is disposable")


def open_store(spark: SparkSession, kind: str, path: str | None = None) -> Store:
    """A store by name: ``memory`` lasts as long as the shared folder, ``files`` is at a path."""
    if kind == "memory":
        return Store(spark, shared_path(spark, "store"))
    if kind == "files" and path:
        return Store(spark, path)
    raise ValueError(f"no store {kind} at {path}")


class Alias:
    """A name for the current version of a rebuilt table, in a folder, so that it outlives the session.

    The version before stays for rolling back.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.records = spark, Versions(spark, folder)

    def path(self) -> str | None:
        return (self.records.last()[1] or {}).get("path")

    def previous(self) -> str | None:
        return (self.records.last()[1] or {}).get("previous")

    def read(self) -> DataFrame:
        if self.path() is None:
            raise KeyError("nothing is promoted yet")
        return self.spark.read.parquet(self.path())

    def promote(self, path: str, expected: int) -> None:
        """Points to a table that is written whole; one with another number of rows is refused and nothing changes."""
        found = self.spark.read.parquet(path).count()
        if found != expected:
            raise ValueError(f"{found} rows instead of {expected}; the alias is left as it was")
        self.records.append({"path": path, "previous": self.path()})

    def roll_back(self) -> None:
        """Swaps the current version and the one before."""
        if self.previous() is None:
            raise ValueError("no earlier version")
        self.records.append({"path": self.previous(), "previous": self.path()})


def plan_create(exists: bool, documents: int, force: bool = False) -> dict:
    """Whether a target is created and its settings applied: never on a filled one, unless forced."""
    if not exists:
        return {"create": True, "apply_settings": True, "reason": "missing"}
    if not documents:
        return {"create": False, "apply_settings": True, "reason": "empty"}
    return {"create": False, "apply_settings": force, "reason": "forced" if force else f"holds {documents} documents"}
