"""Versioned Parquet storage of tables: an append-only log of puts and deletes under numbered manifests.

    root/<table>/_manifest/<version>.json   one file a commit, created only if absent
    root/<table>/data/_commit=<version>     Parquet of that commit, by shard
    root/<table>/index/_commit=<version>    postings of that commit, by column and hash bucket of the term
    root/<table>/backup/<id>, checkpoint    manifests that name files, which never change

All access goes through Hadoop's FileSystem, so any store that Spark reads
will do.  A commit that finds its number taken fails and can be retried.

All commits are one scan under the schema that the manifest holds.  Beyond
``FAN`` commits the tail is merged into one (newest entry of each key, deletes
too), or the whole table compacted once the tail outweighs the first file, so
scans and manifests stay short and a row is rewritten a few times only.
"""

from __future__ import annotations

import json
import tempfile
import time
import uuid
import zlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..errors import TableError
from ..functions.analyzer import Analyzer
from ..operators import index
from ..operators.retention import fifo, live
from ..operators.writes import PUT, current
from ..plans.keys import shard_of
from ..spec import TableSpec

HIDDEN = ("_ver", "_seq", "_op", "_write_ts", "_shard")
FAN = 32  # commits in a row before they are merged
SPREAD = 16  # files that a shard's part of a large commit may be dealt to
INDEX_BUCKETS = 64
PART_BYTES = 4 << 20  # of Parquet that a task of an index's making gets; its postings take some ten times that and more
PART_ROWS = 500_000
BUCKET_PARTS = 32  # tasks that share the files of a salt


@dataclass(frozen=True)
class Manifest:
    spec: TableSpec
    version: int
    files: tuple[str, ...]
    compacted: bool = False
    index_since: tuple[tuple[str, int], ...] = ()
    schema: str | None = None  # of the log, as JSON; none where commits differ in the type of a column
    index_files: tuple[str, ...] = ()

    def to_json(self) -> str:
        return json.dumps({"spec": json.loads(self.spec.to_json()), "version": self.version, "files": self.files, "compacted": self.compacted, "index_since": self.index_since, "schema": self.schema, "index_files": self.index_files})

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        d = json.loads(text)
        return cls(TableSpec.from_json(json.dumps(d["spec"])), d["version"], tuple(d["files"]), d["compacted"], tuple((c, v) for c, v in d["index_since"]), d["schema"], tuple(d["index_files"]))


def scratch(spark: SparkSession) -> str:
    """A new folder for tables of one run, in the shared folder that the cluster names; our own only in one process that names none."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="kestrata-"))
    return f"{context._jsc.sc().getCheckpointDir().get()}/tables-{uuid.uuid4().hex}"


def _joined_schema(m: Manifest, new: StructType) -> str | None:
    """The log's schema with the columns of one more commit; none where types differ."""
    if m.files and m.schema is None:
        return None
    known = {f.name: f for f in StructType.fromJson(json.loads(m.schema))} if m.schema else {}
    for f in new:
        if f.name in known and known[f.name].dataType != f.dataType:
            return None
        known.setdefault(f.name, f)
    return StructType([StructField(f.name, f.dataType) for f in known.values()]).json()


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # files

    def _list(self, path: str) -> list[Any]:
        p = self._path(path)
        return list(self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _read(self, path: str) -> str:
        with_stream = self._fs.open(self._path(path))
        try:
            return bytes(with_stream.readAllBytes()).decode()
        finally:
            with_stream.close()

    def _create(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def size(self, path: str) -> int:
        p = self._path(path)
        return int(self._fs.getContentSummary(p).getLength()) if self._fs.exists(p) else 0

    # manifests

    def home(self, name: str) -> str:
        return f"{self.root}/{name}"

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._list(self.root) if s.isDirectory() and self._fs.exists(self._path(f"{self.root}/{s.getPath().getName()}/_manifest")))

    def manifest(self, name: str) -> Manifest:
        versions = [s.getPath().getName() for s in self._list(f"{self.home(name)}/_manifest")]
        if not versions:
            raise TableError("no_table")
        return Manifest.from_json(self._read(f"{self.home(name)}/_manifest/{max(versions)}"))

    def commit(self, m: Manifest) -> Manifest:
        path = f"{self.home(m.spec.name)}/_manifest/{m.version:012d}.json"
        if self._fs.exists(self._path(path)):
            raise TableError("conflict")
        self._create(path, m.to_json())
        return m

    def create(self, spec: TableSpec) -> Manifest:
        if spec.name in self.names():
            raise TableError("table_exists")
        return self.commit(Manifest(spec, 1, ()))

    def alter(self, m: Manifest, spec: TableSpec, **more: Any) -> Manifest:
        return self.commit(replace(m, spec=spec, version=m.version + 1, **more))

    # rows

    def append(self, name: str, rows: DataFrame, op: str = PUT, order_by: Sequence[str] = (), write_ts: Any = None) -> Manifest:
        """Append one batch; of rows with one key, the last by ``order_by`` (else by position) counts."""
        m = self.manifest(name)
        version = m.version + 1
        values = [c for c in rows.columns if c not in m.spec.key]
        stamped = rows.withColumns({
            "_ver": F.lit(version).cast("long"),
            "_seq": F.struct(*order_by) if order_by else F.monotonically_increasing_id(),
            "_op": F.lit(op),
            "_write_ts": F.current_timestamp() if write_ts is None else F.lit(write_ts).cast("timestamp"),
        })
        if order_by:  # one row a key is left, so positions need not be kept
            stamped = current(stamped.withColumn("_keep", F.col("_op")).drop("_op"), m.spec.key, [F.desc("_seq")]).withColumnRenamed("_keep", "_op").withColumn("_seq", F.lit(0).cast("long"))
        stamped = stamped.withColumn("_shard", shard_of(m.spec.hash_key, m.spec.num_of_shards))
        target = f"{self.home(name)}/data/_commit={version:012d}"
        self._write(m.spec, stamped, target)
        columns = m.spec.columns + tuple(c for c in values if c not in m.spec.columns)
        new = replace(m, spec=replace(m.spec, columns=columns), version=version, files=(*m.files, target), compacted=False, schema=_joined_schema(m, stamped.schema))
        on = {c: o for c, o in m.spec.index_on.items() if c in values} if op == PUT else {}
        if on:
            written = self.spark.read.parquet(target)
            parts = self._parts([target], written)
            if not order_by:
                written = current(written.repartition(parts, *m.spec.key), m.spec.key, [F.desc("_seq")])
            new = replace(new, index_files=(*m.index_files, self._write_index(new, written, on, parts)))
        new = self.commit(new)
        return self._merged(new) if len(new.files) > FAN else new

    def _write(self, spec: TableSpec, rows: DataFrame, target: str) -> None:
        """By shard, sorted by key; small commits come down to one task, large ones to SPREAD tasks a shard."""
        salt = F.pmod(F.xxhash64(*spec.key), F.lit(SPREAD))
        rows.repartition("_shard", salt).sortWithinPartitions("_shard", *spec.key).write.partitionBy("_shard").parquet(target)

    def log(self, m: Manifest, files: Sequence[str] | None = None) -> DataFrame | None:
        """Every entry, in one scan; commits that differ in the type of a column are read one by one and merged by name."""
        files = m.files if files is None else files
        if not files:
            return None
        if m.schema is not None:
            return self.spark.read.schema(StructType.fromJson(json.loads(m.schema))).option("basePath", f"{self.home(m.spec.name)}/data").parquet(*files).drop("_commit")
        out = None
        for f in files:
            part = self.spark.read.option("basePath", f).parquet(f)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def rows(self, m: Manifest, as_of: Any = None, hidden: bool = False, at: Mapping[str, Any] | None = None) -> DataFrame:
        """Current rows: newest puts, without those past the table's ttl or its share of bytes.

        With ``at`` (values of the hash key at least), those of the one shard that can hold them; only its files are read.
        """
        log = self.log(m)
        if log is None:
            raise TableError("empty")
        if at is not None:
            log = log.where(F.col("_shard") == shard_of(m.spec.hash_key, m.spec.num_of_shards, at, log.schema))
        out = log.where(F.col("_op") == PUT).drop("_op") if m.compacted else current(log, m.spec.key, [F.desc("_ver"), F.desc("_seq")])
        now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
        if m.spec.ttl is not None:
            out = live(out, "_write_ts", m.spec.ttl, now)
        if m.spec.fifo_ttl is not None:
            seconds, size = m.spec.fifo_ttl
            out = live(out, "_write_ts", seconds, now)
            # a row's bytes are those of its JSON; of rows written at once, a hash of the key decides
            place = F.shiftright(F.unix_micros("_write_ts"), 20) * 4096 + F.pmod(F.xxhash64(*m.spec.key), F.lit(4096))
            held = F.octet_length(F.to_json(F.struct(*m.spec.key, *m.spec.columns)))
            out = fifo(out, F.col("_shard"), [F.desc("_write_ts"), *[F.desc(k) for k in m.spec.key]], held, size, m.spec.num_of_shards, place)
        return out if hidden else out.drop(*HIDDEN)

    def compact(self, name: str, as_of: Any = None) -> Manifest:
        """Rewrite the current rows as one commit; tombstones, old versions and expired rows go from the new manifest, and stale postings with them."""
        m = self.manifest(name)
        if not m.files:
            return m
        version = m.version + 1
        target = f"{self.home(name)}/data/_commit={version:012d}"
        self._write(m.spec, self.rows(m, as_of, hidden=True).withColumn("_op", F.lit(PUT)), target)
        new = replace(m, version=version, files=(target,), compacted=True)
        return self.commit(self._index_merged(new))

    def _merged(self, m: Manifest) -> Manifest:
        """The commits behind the first as one, or everything where they outweigh it."""
        tail = m.files[1:]
        if sum(map(self.size, tail)) > self.size(m.files[0]):
            return self.compact(m.spec.name)
        version = m.version + 1
        target = f"{self.home(m.spec.name)}/data/_commit={version:012d}"
        log = self.log(m, tail).withColumnRenamed("_op", "_kind")  # deletes stay: they hide rows of the first
        self._write(m.spec, current(log, m.spec.key, [F.desc("_ver"), F.desc("_seq")]).withColumnRenamed("_kind", "_op"), target)
        return self.commit(self._index_merged(replace(m, version=version, files=(m.files[0], target))))

    # index

    def _parts(self, files: Sequence[str], rows: DataFrame) -> int:
        """Tasks for an index over ``rows`` of these files, so that none gets more as the table grows."""
        return max(1, -(-sum(map(self.size, files)) // PART_BYTES), -(-rows.count() // PART_ROWS))

    def _write_index(self, m: Manifest, rows: DataFrame, on: Mapping[str, Any], parts: int) -> str:
        """Postings of the columns ``on`` of rows (one a key, with hidden columns; dealt by key), and where they are."""
        every = None
        for c, options in on.items():
            found = index.postings(rows, m.spec, c, Analyzer.of(options), "_write_ts", more=("_ver",)).withColumn("_column", F.lit(c))
            every = found if every is None else every.unionByName(found)
        return self._put_index(m, every, parts)

    def _put_index(self, m: Manifest, postings: DataFrame, parts: int) -> str:
        """By column and bucket, sorted by term; of large tables, a bucket's postings are dealt to several tasks and files."""
        target = f"{self.home(m.spec.name)}/index/_commit={m.version:012d}"
        bucketed = postings.withColumn("_bucket", F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(INDEX_BUCKETS)).cast("int"))
        salt = F.pmod(F.xxhash64(*m.spec.key), F.lit(-(-parts // BUCKET_PARTS)))
        bucketed.repartition(parts, "_column", "_bucket", salt).sortWithinPartitions("_column", "_bucket", "term").write.partitionBy("_column", "_bucket").parquet(target)
        return target

    def backfilled(self, m: Manifest, on: Mapping[str, Any]) -> Manifest:
        """``m`` with postings of the columns ``on`` of all current rows."""
        own = {c: o for c, o in on.items() if c in m.spec.columns}
        if not own or not m.files:
            return m
        parts = self._parts(m.files, self.log(m))
        return replace(m, index_files=(*m.index_files, self._write_index(m, self.rows(m, hidden=True).repartition(parts, *m.spec.key), own, parts)))

    def postings(self, m: Manifest, terms: Mapping[str, Sequence[str]] | None = None) -> DataFrame | None:
        """Stored postings (key, ts, term, freq, pos, _column) of current rows; with ``terms`` by column, only their buckets are read."""
        if not m.index_files or not m.files:
            return None
        since = dict(m.index_since)
        found = self.spark.read.option("basePath", f"{self.home(m.spec.name)}/index").option("mergeSchema", "true").parquet(*m.index_files).drop("_commit")
        where = F.lit(False)
        for c in m.spec.index_on if terms is None else terms:
            own = (F.col("_column") == c) & (F.col("_ver") >= since.get(c, 0))
            if terms is not None:
                buckets = [zlib.crc32(t.encode()) % INDEX_BUCKETS for t in terms[c]]
                own &= F.col("_bucket").isin(buckets) & F.col("term").isin(list(terms[c]))
            where |= own
        key = list(m.spec.key)
        found = found.where(where).drop("_bucket")
        if terms is None:  # all postings meet their rows in tasks of bounded size
            found = found.repartition(self._parts(m.index_files, self.log(m)), *key, "_ver")
        found = found.distinct()  # a column indexed anew may have its postings twice
        # the versions of the keys found, from the log's key columns alone
        own = self.log(m).select(*key, "_ver", "_seq", "_op", "_write_ts", "_shard")
        if terms is not None:
            own = own.join(found.select(*key).distinct(), key, "left_semi")
        own = current(own, key, [F.desc("_ver"), F.desc("_seq")])
        if m.spec.ttl is not None or m.spec.fifo_ttl is not None:
            own = live(own, "_write_ts", m.spec.ttl if m.spec.ttl is not None else m.spec.fifo_ttl[0], F.current_timestamp())
        return found.join(own.select(*key, "_ver"), [*key, "_ver"])

    def _index_merged(self, m: Manifest) -> Manifest:
        """``m`` with one index file, without postings of rows or columns that are gone."""
        found = self.postings(m) if len(m.index_files) > 1 else None
        return m if found is None else replace(m, index_files=(self._put_index(m, found, self._parts(m.index_files, self.log(m))),))

    # copies

    def snapshot(self, name: str, where: str) -> None:
        """A manifest under ``where``: data files never change, so naming them keeps them."""
        m = self.manifest(name)
        base = f"{self.home(name)}/{where}"
        self._fs.mkdirs(self._path(base))
        self._create(f"{base}/manifest.json", json.dumps({"manifest": m.to_json(), "timestamp": int(time.time())}))

    def backups(self, name: str) -> list[dict[str, Any]]:
        out = []
        for s in self._list(f"{self.home(name)}/backup"):
            d = json.loads(self._read(f"{self.home(name)}/backup/{s.getPath().getName()}/manifest.json"))
            files = Manifest.from_json(d["manifest"]).files
            out.append({"backup_id": int(s.getPath().getName()), "timestamp": d["timestamp"], "size": sum(map(self.size, files)), "number_of_files": sum(int(self._fs.getContentSummary(self._path(f)).getFileCount()) for f in files)})
        return sorted(out, key=lambda b: b["backup_id"])

    def restore(self, name: str, where: str) -> Manifest:
        old = Manifest.from_json(json.loads(self._read(f"{self.home(name)}/{where}/manifest.json"))["manifest"])
        return self.commit(replace(old, version=self.manifest(name).version + 1))
