"""Tables that change together, one numbered commit at a time, by several writers.

A store is a folder. What a change writes goes to Parquet folders of its own first; the commit
that names them comes last, as a file that is created only if it does not exist yet. So a change
is there whole or not at all, whatever fails before, and of two writers who saw the same version one
wins; the other one takes its change again on what the first has left, unless they touch different
keys. Readers see the newest commit and nothing else.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.operators.store import stored

#: A keyed table is folded into one part when it has more changes than this.
MOST_PARTS = 12
TRIES = 30


class Conflict(RuntimeError):
    """Other writers were faster at every try."""


@dataclass(frozen=True)
class Table:
    """A table's columns, and its key; without a key rows are only added.

    order, for the rows of a part, is how they are dealt to files and sorted in them; partition is a
    column that makes folders, and options are the writer's.
    """

    schema: str
    key: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    partition: str | None = None
    options: tuple[tuple[str, str], ...] = ()


@dataclass
class Change:
    """What a commit does: rows to put, by table (in place of those with their key), and keys to drop.

    whole has tables that are written anew. marks are named values that stand beside the tables,
    such as cursors. distinct names tables whose rows to put do not repeat a key, so that this needs
    no look.
    """

    put: dict[str, DataFrame] = field(default_factory=dict)
    drop: dict[str, DataFrame] = field(default_factory=dict)
    marks: dict[str, object] = field(default_factory=dict)
    whole: dict[str, DataFrame] = field(default_factory=dict)
    distinct: frozenset[str] = frozenset()


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows, which the planner knows: joins with it are left out."""
    return spark.createDataFrame([], schema).where(F.lit(False))


def _same(a: DataFrame, b: DataFrame, key: Iterable[str]) -> Column:
    out = F.lit(True)
    for c in key:
        out = out & a[c].eqNullSafe(b[c])
    return out


class Files:
    """The file system of a folder, with what a store needs of it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str) -> object:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """The file with all of its text, or False if there is one of that name already; never a part of it."""
        part, to = self.path(f"_parts/{uuid.uuid4().hex}"), self.path(name)
        self.fs.mkdirs(to.getParent())
        stream = self.fs.create(part, False)
        stream.write(text.encode())
        stream.close()
        try:
            if self.fs.getScheme() == "file":  # where a rename would replace another one's file
                there, own = (self.jvm.java.io.File(p.toUri().getPath()).toPath() for p in (to, part))
                self.jvm.java.nio.file.Files.createLink(there, own)
            else:
                rename = self.jvm.org.apache.hadoop.fs.Options.Rename
                how = self.spark.sparkContext._gateway.new_array(rename, 1)
                how[0] = rename.NONE
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(part, to, how)
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            self.fs.delete(part, False)
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


@dataclass(frozen=True)
class Commit:
    """A version: the parts of each table, oldest first, the marks, and the keys that the change touched (None: any)."""

    version: int
    parts: dict[str, list[str]]
    marks: dict[str, object]
    keys: list[str] | None

    def text(self) -> str:
        return json.dumps({"parts": self.parts, "marks": self.marks, "keys": self.keys})


class Snapshot:
    """The tables as of one commit."""

    def __init__(self, store: Store, commit: Commit) -> None:
        self.store, self.commit = store, commit
        self.version, self.marks = commit.version, commit.marks

    def table(self, name: str) -> DataFrame:
        """The rows of a table. Of a keyed one the last change of each key stands; changes are few, so what is not changed is not shuffled for them."""
        kind, spark = self.store.tables[name], self.store.spark
        parts = [f"{self.store.root}/{p}" for p in self.commit.parts.get(name, [])]
        if not parts:
            return empty(spark, kind.schema)
        read = lambda p, more="": spark.read.schema(kind.schema + more).parquet(*p)
        if not kind.key:
            if not kind.partition:
                return read(parts)
            out = read(parts[:1])  # folders of partitions are looked for under one path at a time
            for p in parts[1:]:
                out = out.unionByName(read([p]))
            return out
        base = read(parts[:1])
        if len(parts) == 1:
            return base
        changes = None
        for i, p in enumerate(parts[1:]):
            own = read([p], ", _gone boolean").withColumn("_v", F.lit(i))
            changes = changes.unionByName(own) if changes is not None else own
        row = F.struct(*base.columns, "_gone")
        last = changes.groupBy(*kind.key).agg(F.max_by(row, "_v").alias("r")).select("r.*")
        return base.join(last, _same(base, last, kind.key), "left_anti").unionByName(last.where("not _gone").drop("_gone"))


class Store:
    """Versioned tables under a folder."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table]) -> None:
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables
        self.files = Files(spark, root)

    # --- reading

    def version(self) -> int:
        """The newest commit; 0 before the first."""
        return max((int(n.split(".")[0]) for n in self.files.names("_commits")), default=0)

    def commit(self, version: int) -> Commit:
        if not version:
            return Commit(0, {}, {}, [])
        x = json.loads(self.files.read(f"_commits/{version:020d}.json"))
        return Commit(version, x["parts"], x["marks"], x["keys"])

    def snapshot(self, version: int | None = None) -> Snapshot:
        return Snapshot(self, self.commit(self.version() if version is None else version))

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self.snapshot(version).table(name)

    # --- changing

    def _write(self, rows: DataFrame, name: str) -> str:
        """rows in a new part of the table."""
        part, kind = f"{name}/{uuid.uuid4().hex}", self.tables[name]
        if kind.order:
            rows = rows.repartitionByRange(*kind.order).sortWithinPartitions(*kind.order)
        to = rows.write.options(**dict(kind.options))
        (to.partitionBy(kind.partition) if kind.partition else to).parquet(f"{self.root}/{part}")
        return part

    def _written(self, change: Change, last: Commit) -> tuple[dict[str, str], set[str]]:
        """The new parts, and those that can be a keyed table's first: without repeated keys, and nothing dropped."""
        out, first = {}, set()
        for name in {**change.put, **change.drop}:
            kind = self.tables[name]
            none = empty(self.spark, kind.schema)
            put = change.put.get(name, none).select(*none.columns)
            begins = not last.parts.get(name)
            if kind.key:
                if begins and name not in change.distinct:
                    put = put.dropDuplicates(list(kind.key))
                put = put.withColumn("_gone", F.lit(False))
                if name in change.drop and not begins:  # a table without rows has none to drop
                    keys = change.drop[name].select(*kind.key).distinct()
                    kept = keys.join(put, _same(keys, put, kind.key), "left_anti")  # what is put as well stays
                    put = put.unionByName(kept.withColumn("_gone", F.lit(True)), allowMissingColumns=True)
            elif name in change.drop:
                raise ValueError(f"{name} has no key to drop rows by")
            out[name] = self._write(put, name)
            if begins:
                first.add(out[name])
        return out, first

    def _committed(self, last: Commit, new: dict[str, str], whole: dict[str, str], marks: dict[str, object], keys: list[str] | None, first: set[str]) -> bool:
        parts = {t: list(p) for t, p in last.parts.items()} | {t: [p] for t, p in whole.items()}
        for name, part in new.items():
            own = parts.setdefault(name, [])
            if self.tables[name].key and not own and part not in first:  # the first part of a keyed table is one without changes
                own.append(self._write(empty(self.spark, self.tables[name].schema), name))
            own.append(part)
        at = Commit(last.version + 1, parts, last.marks | marks, keys)
        return self.files.create(f"_commits/{at.version:020d}.json", at.text())

    def update(self, change: Callable[[Snapshot], Change | None], keys: Iterable[str] | None = None, tries: int = TRIES) -> int:
        """Commits what change makes of the newest snapshot; returns the version, or the present one if it makes None.

        keys are names for all that the change reads and writes (None: anything; a table written anew
        is read whole). If another
        writer commits meanwhile, a change with other keys is put on top of that as it is; else
        change is called again with the new snapshot. Conflict is raised after so many calls.
        """
        own = None if keys is None else sorted(set(keys))
        for _ in range(tries):
            seen = self.snapshot()
            wanted = change(seen)
            if wanted is None:
                return seen.version
            last = seen.commit
            new, first = self._written(wanted, last)
            whole = {t: self._write(rows, t) for t, rows in wanted.whole.items()}
            while not self._committed(last, new, whole, wanted.marks, own, first):
                # the next commits one by one: each may touch what was read
                last = self.commit(last.version + 1)
                if own is None or last.keys is None or set(own) & set(last.keys):
                    break
            else:
                self._fold()
                return last.version + 1
            for part in (*new.values(), *whole.values()):
                self.files.delete(part)
        raise Conflict(f"{tries} tries on {self.root}")

    def _fold(self) -> None:
        """Makes one part of every keyed table that has too many; if another writer is faster, they are left."""
        last = self.commit(self.version())
        many = [t for t, p in last.parts.items() if self.tables[t].key and len(p) > MOST_PARTS]
        if many:
            now = Snapshot(self, last)
            parts = last.parts | {t: [self._write(now.table(t), t)] for t in many}
            at = Commit(last.version + 1, parts, last.marks, [])  # no row changes, so it is in nobody's way
            self.files.create(f"_commits/{at.version:020d}.json", at.text())

    def clean(self, keep: int = 10) -> None:
        """Deletes all but the newest commits, and parts that none of these names; for when nobody writes or reads older ones."""
        last = self.version()
        kept = [self.commit(v) for v in range(max(1, last - keep + 1), last + 1)]
        for n in self.files.names("_commits"):
            if int(n.split(".")[0]) <= last - keep:
                self.files.delete(f"_commits/{n}")
        named = {p for c in kept for own in c.parts.values() for p in own}
        for t in self.tables:
            for n in self.files.names(t):
                if f"{t}/{n}" not in named:
                    self.files.delete(f"{t}/{n}")


def replaced(old: DataFrame, new: DataFrame, key: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """(put, drop): what makes new out of old, two states of some rows of a table with that key."""
    key = list(key)
    before, after = old.select(F.struct(*old.columns).alias("o")), new.select(F.struct(*old.columns).alias("n"))
    on = F.lit(True)
    for c in key:
        on = on & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    both = stored(before.join(after, on, "full"), "replaced")
    put = both.where(F.col("n").isNotNull() & ~F.col("o").eqNullSafe(F.col("n"))).select("n.*")
    return put, both.where(F.col("n").isNull()).select(*[F.col(f"o.{c}") for c in key])
