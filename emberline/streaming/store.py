"""A store of tables in a folder, published by numbered manifests, with one writer at a time across hosts.

Each version of a table is written whole to a folder of its own, or as parts by day, of which only those that changed are
written again. A manifest names the version of every table (or part); the highest number counts, so readers see the tables
of one cycle together and a writer that dies leaves the last ones.

The right to write is a lease: a numbered file with an owner and a time of expiry. The number is a fence. A writer whose
lease has run out may be alive, so its number goes into the names of its versions, `publish` refuses it once a newer
lease exists, and taking over a lease that was not given back moves the manifests on by one, which makes a publication
that was already under way fail. `clean` removes only what a published manifest has named before, what a writer with an
older fence has left, and what is older than a lease.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.sinks import create_text, read_text, write_text

#: Seconds that a lease holds without being renewed.
LEASE_S = 1800.0
#: Manifests whose tables are kept for readers that have just opened them.
KEEP = 3
PART = "_part"

Entry = str | dict[str, str]


class Locked(RuntimeError):
    """Another writer runs, or has run since."""


class Lease:
    """The right to write a store until it expires, is given back, or, once expired, is taken over."""

    def __init__(self, store: Store, seconds: float = LEASE_S, owner: str | None = None, clock: Callable[[], float] = time.time):
        self.store, self.seconds, self.owner, self.clock = store, seconds, owner or uuid.uuid4().hex, clock
        self.number = 0

    def _path(self, number: int) -> str:
        return f"{self.store.folder}/leases/{number:012d}"

    def _record(self, until: float) -> str:
        return json.dumps({"owner": self.owner, "until": until, "said": datetime.fromtimestamp(until, UTC).isoformat() if until else "given back"})

    def acquire(self) -> Lease:
        newest = self.store.numbers("leases")
        held = json.loads(read_text(self.store.spark, self._path(newest[-1])) or "{}") if newest else {"until": 0}
        if held.get("until", 0) > self.clock():
            raise Locked(f"{held['owner']} holds the store until {held['said']}")
        number = newest[-1] + 1 if newest else 1
        if not create_text(self.store.spark, self._path(number), self._record(self.clock() + self.seconds)):
            raise Locked("another writer has just taken the lease")
        self.number = number
        if held.get("until", 0):
            self.store.move_on()
        for old in newest[:-1]:
            self.store.remove(self._path(old))
        return self

    def check(self) -> None:
        """Raises if the lease has run out or a newer one exists."""
        newest = self.store.numbers("leases")
        held = json.loads(read_text(self.store.spark, self._path(self.number)) or "{}") if self.number else {}
        if not self.number or newest[-1:] != [self.number] or held.get("until", 0) <= self.clock():
            raise Locked(f"lease {self.number} is no longer held")

    def renew(self) -> None:
        self.check()
        write_text(self.store.spark, self._path(self.number), self._record(self.clock() + self.seconds))

    def release(self) -> None:
        """Give the lease back, if it is still the newest."""
        if self.number and self.store.numbers("leases")[-1:] == [self.number]:
            write_text(self.store.spark, self._path(self.number), self._record(0))
        self.number = 0

    def __enter__(self) -> Lease:
        return self.acquire()

    def __exit__(self, *_) -> None:
        self.release()


class Store:
    """Tables in a folder that all hosts share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _list(self, *parts: str) -> list:
        fs, path = self._files()
        folder = path("/".join([self.folder, *parts]))
        return list(fs.listStatus(folder)) if fs.exists(folder) else []

    def remove(self, full_path: str) -> bool:
        fs, path = self._files()
        return bool(fs.delete(path(full_path), True))

    def numbers(self, kind: str) -> list[int]:
        names = (s.getPath().getName() for s in self._list(kind))
        return sorted(int(n) for n in names if re.fullmatch(r"\d{12}", n))

    def manifests(self) -> list[int]:
        return self.numbers("manifests")

    def manifest(self, number: int | None = None) -> dict[str, Entry]:
        known = self.manifests()
        if number is None and not known:
            return {}
        text = read_text(self.spark, f"{self.folder}/manifests/{known[-1] if number is None else number:012d}")
        return json.loads(text) if text else {}

    # reading

    def _paths(self, name: str, entry: Entry, parts: list[str] | None = None) -> list[str]:
        if isinstance(entry, str):
            return [f"{self.folder}/{name}/{entry}"]
        return [f"{self.folder}/{name}/{version}/{PART}={part}" for part, version in sorted(entry.items()) if parts is None or part in parts]

    def read(self, name: str, pending: dict[str, Entry] | None = None, parts: list[str] | None = None, number: int | None = None) -> DataFrame | None:
        """A table as last published (or as pending, or of an older manifest); of a table in parts, all or some of them.

        None if there is no such table, or none of the parts.
        """
        entry = {**self.manifest(number), **(pending or {})}.get(name)
        paths = [] if entry is None else self._paths(name, entry, parts)
        return self.spark.read.parquet(*paths) if paths else None

    # writing

    def _version(self, lease: Lease | None) -> str:
        return f"{lease.number if lease else 0:012d}-{uuid.uuid4().hex}"

    def write(self, name: str, df: DataFrame, pending: dict[str, Entry], lease: Lease | None = None) -> DataFrame:
        """Write a version that `publish` will name; nobody reads it before."""
        version = self._version(lease)
        path = f"{self.folder}/{name}/{version}"
        df.write.parquet(path)
        pending[name] = version
        return self.spark.read.parquet(path)

    def write_parts(self, name: str, df: DataFrame, by: str, pending: dict[str, Entry], lease: Lease | None = None) -> list[str]:
        """Write the parts that rows of `df` belong to, which replace those of the same value; others stay. Returns the values."""
        version = self._version(lease)
        path = f"{self.folder}/{name}/{version}"
        df.withColumn(PART, F.col(by).cast("string")).write.partitionBy(PART).parquet(path)
        names = (s.getPath().getName() for s in self._list(name, version))
        found = sorted(n.partition("=")[2] for n in names if n.startswith(f"{PART}="))
        held = {**self.manifest(), **pending}.get(name, {})
        pending[name] = {**(held if isinstance(held, dict) else {}), **dict.fromkeys(found, version)}
        return found

    def publish(self, pending: dict[str, Entry], after: int, lease: Lease | None = None) -> None:
        """Make the pending versions, and the last ones of other tables, manifest `after` + 1.

        Raises if another writer has published it, if the lease is no longer held, or, without a lease, if there is one.
        """
        if lease:
            lease.check()
        elif self.numbers("leases"):
            held = json.loads(read_text(self.spark, f"{self.folder}/leases/{self.numbers('leases')[-1]:012d}") or "{}")
            if held.get("until", 0) > time.time():
                raise Locked(f"{held['owner']} holds the store until {held['said']}")
        fs, path = self._files()
        fs.mkdirs(path(f"{self.folder}/manifests"))
        text = json.dumps({**self.manifest(), **pending})
        if not create_text(self.spark, f"{self.folder}/manifests/{after + 1:012d}", text):
            raise Locked(f"another writer has published {after + 1}")

    def move_on(self) -> None:
        """Publish the last manifest once more, so that a publication that was under way fails."""
        while known := self.manifests():
            if create_text(self.spark, f"{self.folder}/manifests/{known[-1] + 1:012d}", json.dumps(self.manifest(known[-1]))):
                return

    def _named(self, number: int) -> set[str]:
        return {p for name, entry in self.manifest(number).items() if not name.startswith("_") for p in self._paths(name, entry)}

    def clean(self, keep: int = KEEP, lease: Lease | None = None, now: float | None = None) -> int:
        """Remove manifests but the last `keep`, and versions and parts that none of those names and that nobody can publish
        any more: those that a removed manifest named, those of older leases, and those older than a lease. How many went."""
        known = self.manifests()
        held = set().union(*(self._named(n) for n in known[-keep:])) if known else set()
        past = set().union(*(self._named(n) for n in known[:-keep])) if known[:-keep] else set()
        tables = {p.removeprefix(f"{self.folder}/").split("/")[0] for p in held | past}
        gone = 0
        for name in sorted(tables):
            for status in self._list(name):
                version, path = status.getPath().getName(), f"{self.folder}/{name}/{status.getPath().getName()}"
                fence = int(version[:12]) if re.match(r"\d{12}-", version) else 0
                dead = bool(lease) and fence < lease.number or status.getModificationTime() / 1000 < (now or time.time()) - LEASE_S
                whole = {p for p in held if p == path or p.startswith(f"{path}/")}
                before = {p for p in past if p == path or p.startswith(f"{path}/")}
                if not whole:
                    if dead or before:
                        gone += self.remove(path)
                elif path not in whole:
                    gone += sum(self.remove(p) for p in before - whole)
        for number in known[:-keep]:
            self.remove(f"{self.folder}/manifests/{number:012d}")
        return gone

    # changes

    def changes(self, name: str, key: list[str], since: int, until: int | None = None) -> DataFrame:
        """What to do to a table of manifest `since` to get that of `until` (the last one): rows (op, ...columns) with op
        insert, update or delete, found by key and by a hash of the content.

        Keys are unique in a table, or null once. A part that both manifests name with one version is not read. Keep `since` and ask again from `until` to go on; a manifest that has been
        cleaned away raises, and its reader starts again from a whole table.
        """
        last = self.manifests()[-1] if until is None else until
        entries = []
        for number in (since, last):
            if number and number not in self.manifests():
                raise LookupError(f"manifest {number} is gone; read the whole table")
            entries.append(self.manifest(number).get(name) if number else None)
        old, new = entries
        if isinstance(old, dict) and isinstance(new, dict):
            old, new = ({p: v for p, v in a.items() if b.get(p) != v} for a, b in ((old, new), (new, old)))
        elif old == new:
            old = new = {}
        sides = [self.spark.read.parquet(*paths) if entry and (paths := self._paths(name, entry)) else None for entry in (old, new)]
        known = next((s for s in sides[::-1] if s is not None), None)
        if known is None:
            whole = self.read(name)
            if whole is None:
                raise LookupError(f"there is no table {name}")
            return whole.limit(0).select(F.lit("insert").alias("op"), "*")
        columns = known.columns
        rest = [c for c in columns if c not in key]
        marked = []
        for k, side in enumerate(sides):
            rows = known.limit(0) if side is None else side
            content = F.sha2(F.to_json(F.struct(*(F.col(c) for c in rest)), {"ignoreNullFields": "false"}), 256)
            marked.append(rows.select(*columns).withColumns({"_side": F.lit(k), "_content": content}))
        both = marked[0].unionByName(marked[1])
        # a row of each key, side and content, with its count; partial sums, so repeated rows meet early
        counted = both.groupBy(*key, "_side", "_content").agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_row") if rest else F.lit(None).alias("_row"))
        sums = [F.sum(F.when(F.col("_side") == k, F.col("_n")).otherwise(0)).alias(f"_n{k}") for k in (0, 1)]
        folded = counted.groupBy(*key, "_content").agg(*sums, F.first("_row", ignorenulls=True).alias("_row"))
        moved = folded.filter(F.col("_n0") != F.col("_n1")).groupBy(*key).agg(
            *(F.max(F.struct((F.col(n) > 0).alias("there"), "_row")).alias(side) for n, side in (("_n1", "_in"), ("_n0", "_out")))
        )
        op = F.when(~F.col("_in.there"), "delete").when(~F.col("_out.there"), "insert").otherwise("update")
        row = F.when(F.col("_in.there"), F.col("_in._row")).otherwise(F.col("_out._row"))
        picked = moved.select(op.alias("op"), *key, row.alias("_row"))
        return picked.select("op", *(F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in columns))


def applied(old: DataFrame, feed: DataFrame, key: list[str]) -> DataFrame:
    """A table after a change feed: with one row for each key, the feed from n to m applied to n is m."""
    columns = old.columns
    same = None
    renamed = feed.select(*(F.col(k).alias(f"_{k}") for k in key))
    for k in key:
        one = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = one if same is None else same & one
    return old.join(renamed, same, "left_anti").unionByName(feed.filter(F.col("op") != "delete").select(*columns))
