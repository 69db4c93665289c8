"""Partitioned tables whose every change is complete and verified before it is visible.

A table is a folder of Parquet partitions plus one small version file per change.
A version file names the partition folders it consists of, with row count and
content fingerprint of each, the declared columns and what was done. Writers add
new folders first and their version file last; readers follow the highest one. So
a reader never sees half a change, a writer that dies leaves the table as it was
(and can simply be run again), and partitions a change did not touch keep the
very same folder, which the fingerprints of two versions prove as a table.

Old partitions that lack a column added later are read as NULL there. One writer
at a time: of two that race for a version, the second is refused.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeward.operators.contracts import Contract, enforced
from lakeward.operators.ingest import LoadError, hadoop_path

FINGERPRINT = "value string, folder string, row_count bigint, hash_xor bigint, hash_sum string"


def content_hash(df: DataFrame):
    """A row's hash over its columns by name; a column that is NULL adds nothing, so widening a table changes no hash."""
    return F.xxhash64(*[F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(F.lit(c), F.col(f"`{c}`"))) for c in sorted(df.columns)])


def fingerprints(df: DataFrame, *by: str) -> DataFrame:
    """Row count, XOR and exact sum of content hashes per group."""
    hashed = df.select(*[F.col(f"`{b}`") for b in by], content_hash(df).alias("_h"))
    return hashed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.bit_xor("_h").alias("hash_xor"),
        F.sum(F.col("_h").cast("decimal(38,0)")).cast("string").alias("hash_sum"),
    )


@dataclass(frozen=True)
class Version:
    number: int
    operation: str
    detail: dict
    schema: T.StructType
    partitions: dict  # value as text or None -> {"folder", "row_count", "hash_xor", "hash_sum"}
    committed_at: float

    @property
    def rows(self) -> int:
        return sum(p["row_count"] for p in self.partitions.values())


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, partition_col: str, contract: Contract | None = None):
        self.spark, self.path, self.partition_col, self.contract = spark, path.rstrip("/"), partition_col, contract

    # ------------------------------------------------------------- versions
    def _version_files(self) -> dict[int, str]:
        fs, folder = hadoop_path(self.spark, f"{self.path}/versions")
        if not fs.exists(folder):
            return {}
        names = [str(s.getPath().getName()) for s in fs.listStatus(folder)]
        return {int(n.removesuffix(".json")): f"{self.path}/versions/{n}" for n in names if n.endswith(".json")}

    def version(self, number: int | None = None) -> Version | None:
        """The given version, or the current one; None for a table that has none yet."""
        files = self._version_files()
        if not files:
            return None
        number = max(files) if number is None else number
        if number not in files:
            raise LoadError(f"{self.path} has no version {number}")
        text = self.spark.read.text(files[number], wholetext=True).first()[0]
        v = json.loads(text)
        parts = {p["value"]: p for p in v["partitions"]}
        return Version(number, v["operation"], v["detail"], T.StructType.fromJson(v["schema"]), parts, v["committed_at"])

    def history(self) -> DataFrame:
        """One row per version: what was done and how many rows and partitions there were after it."""
        rows = [(v.number, v.operation, json.dumps(v.detail, sort_keys=True), len(v.partitions), v.rows) for v in map(self.version, sorted(self._version_files()))]
        return self.spark.createDataFrame(rows, "version int, operation string, detail string, partitions int, row_count bigint")

    def _commit(self, base: Version | None, operation: str, detail: dict, schema: T.StructType, partitions: dict) -> Version:
        """The switch: a new version file, written beside and renamed. Refused if the table has moved on since ``base``."""
        number = (base.number if base else 0) + 1
        body = {
            "operation": operation, "detail": detail, "schema": schema.jsonValue(), "committed_at": time.time(),
            "partitions": [{"value": k, **{f: p[f] for f in ("folder", "row_count", "hash_xor", "hash_sum")}} for k, p in partitions.items()],
        }
        fs, final = hadoop_path(self.spark, f"{self.path}/versions/{number:08d}.json")
        _, draft = hadoop_path(self.spark, f"{self.path}/versions/.{number:08d}-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise LoadError(f"{self.path} has got a version {number} from another writer")
        return self.version(number)

    # -------------------------------------------------------------- reading
    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version (the current one by default)."""
        v = self.version(number)
        if v is None:
            raise LoadError(f"{self.path} has no version to read")
        return self._rows(v, list(v.partitions))

    def _rows(self, v: Version, values: list) -> DataFrame:
        folders = [f"{self.path}/{v.partitions[x]['folder']}" for x in values]
        if not folders:
            return self.spark.createDataFrame([], v.schema)
        wide = T.StructType([*v.schema.fields, T.StructField("write", T.StringType())])
        rows = self.spark.read.schema(wide).option("basePath", f"{self.path}/data").parquet(*folders)
        return rows.select(*v.schema.names)

    def partition_fingerprints(self, number: int | None = None) -> DataFrame:
        v = self.version(number)
        return self.spark.createDataFrame([(k, p["folder"], p["row_count"], p["hash_xor"], p["hash_sum"]) for k, p in v.partitions.items()], FINGERPRINT)

    def changes(self, before: int, after: int | None = None) -> DataFrame:
        """Per partition: row counts in both versions and whether it is unchanged, changed, added or removed."""
        a = self.partition_fingerprints(before).alias("a")
        b = self.partition_fingerprints(after).alias("b")
        same = (F.col("a.hash_xor") == F.col("b.hash_xor")) & (F.col("a.hash_sum") == F.col("b.hash_sum")) & (F.col("a.row_count") == F.col("b.row_count"))
        return a.join(b, F.col("a.value").eqNullSafe(F.col("b.value")), "full_outer").select(
            F.coalesce("a.value", "b.value").alias("value"),
            F.col("a.row_count").alias("rows_before"),
            F.col("b.row_count").alias("rows_after"),
            F.when(F.col("a.folder").isNull(), "added").when(F.col("b.folder").isNull(), "removed").when(same, "unchanged").otherwise("changed").alias("change"),
            F.coalesce(F.col("a.folder") == F.col("b.folder"), F.lit(False)).alias("same_files"),
        )

    # -------------------------------------------------------------- writing
    def _stage(self, rows: DataFrame) -> tuple[str, dict]:
        """Write rows as new partition folders that no version names yet; their counts and fingerprints come from what was written."""
        if self.contract:
            extra = [c for c in rows.columns if c not in {n for n, _, _ in self.contract.columns}]
            declared = Contract(self.contract.name, (*self.contract.columns, *((c, dict(rows.dtypes)[c], True) for c in extra)))
            rows = enforced(rows, declared)
        write = f"data/write=w{uuid.uuid4().hex}"
        rows.write.partitionBy(self.partition_col).parquet(f"{self.path}/{write}")
        back = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{write}")
        found = fingerprints(back, self.partition_col).withColumn("_value", F.col(self.partition_col).cast("string"))
        parts = {}
        for r in found.collect():  # one row per partition
            name = "__HIVE_DEFAULT_PARTITION__" if r["_value"] is None else r["_value"]
            folder = f"{write}/{self.partition_col}={name}"
            parts[r["_value"]] = {"folder": folder, "row_count": r["row_count"], "hash_xor": r["hash_xor"], "hash_sum": r["hash_sum"]}
        return write, parts

    def _discard(self, folder: str) -> None:
        fs, p = hadoop_path(self.spark, f"{self.path}/{folder}")
        fs.delete(p, True)

    def full_refresh(self, rows: DataFrame, approved: bool = False, operation: str = "full_refresh") -> Version:
        """Rebuild the table from ``rows`` alone. An existing table is only replaced if that is ``approved``."""
        base = self.version()
        if base is not None and not approved:
            raise LoadError(f"{self.path}: a full refresh replaces {base.rows} rows and has to be approved")
        write, parts = self._stage(rows)
        try:
            return self._commit(base, operation, {"approved": approved}, rows.schema, parts)
        except LoadError:
            self._discard(write)
            raise

    def _widened(self, base: Version, rows: DataFrame, add_columns: bool) -> T.StructType:
        """The table's columns after a write of ``rows``: added columns only where allowed, never retyped or dropped ones."""
        kinds = {f.name: f.dataType for f in base.schema.fields}
        for name, kind in kinds.items():
            if name not in rows.columns:
                raise LoadError(f"columns of the source differ from the table's: {name} is missing")
            if rows.schema[name].dataType != kind:
                raise LoadError(f"columns of the source differ from the table's: {name} is {rows.schema[name].dataType.simpleString()}, not {kind.simpleString()}")
        added = [T.StructField(f.name, f.dataType) for f in rows.schema.fields if f.name not in kinds]
        if added and not add_columns:
            raise LoadError(f"columns of the source differ from the table's: {[f.name for f in added]} added")
        return T.StructType([*base.schema.fields, *added])

    def _replace(self, base: Version, schema: T.StructType, touched: list, rows: DataFrame, operation: str, detail: dict, verify=None) -> Version:
        """Put ``rows`` in the place of the ``touched`` partitions. ``verify(staged)`` may raise before the switch."""
        write, parts = self._stage(rows.select(*schema.names))
        try:
            strays = set(parts) - set(touched)
            if strays:
                raise LoadError(f"rows of partitions outside the change: {sorted(map(str, strays))[:5]}")
            if verify:
                staged = self.spark.read.schema(schema).parquet(f"{self.path}/{write}")
                verify(staged)
            kept = {k: p for k, p in base.partitions.items() if k not in touched}
            return self._commit(base, operation, detail, schema, kept | parts)
        except Exception:
            self._discard(write)
            raise

    def _values(self, rows: DataFrame) -> list:
        return [r[0] for r in rows.select(F.col(self.partition_col).cast("string")).distinct().collect()]  # one per partition

    def merge(self, source: DataFrame, key: str = "event_id", add_columns: bool = False) -> Version:
        """Upsert by key: rows of the source replace those with its keys, in whatever partition they stood. The source
        is written once; NULL and repeated keys and other columns are refused."""
        base = self.version()
        tmp = f"{self.path}/data/source-{uuid.uuid4().hex}"
        try:
            source.write.parquet(tmp)
            new = self.spark.read.schema(source.schema).parquet(tmp)
            faults = new.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(
                F.count_if(F.col(key).isNull()).alias("without"), F.count_if(F.col(key).isNotNull() & (F.col("n") > 1)).alias("repeated")
            ).first()
            if faults["without"]:
                raise LoadError(f"the source holds rows without {key}")
            if faults["repeated"]:
                raise LoadError(f"the source holds a {key} more than once")
            if base is None:
                return self.full_refresh(new, operation="merge")
            schema = self._widened(base, new, add_columns)
            keys = new.select(key)
            old = self._rows(base, list(base.partitions))
            moved = old.join(keys, key, "left_semi")
            touched = self._values(new.select(self.partition_col).union(moved.select(self.partition_col)))
            here = self._rows(base, [v for v in touched if v in base.partitions])
            kept = here.join(keys, key, "left_anti")
            both = kept.unionByName(new, allowMissingColumns=True)
            return self._replace(base, schema, touched, both, "merge", {"key": key, "partitions": len(touched)})
        finally:
            fs, p = hadoop_path(self.spark, tmp)
            fs.delete(p, True)

    def _other_rows(self, base: Version, touched: list, batch_col: str, batch: str) -> DataFrame:
        return self._rows(base, [v for v in touched if v in base.partitions]).where(~F.col(batch_col).eqNullSafe(F.lit(batch)))

    def _batch_partitions(self, base: Version, batch_col: str, batch: str) -> list:
        return self._values(self._rows(base, list(base.partitions)).where(F.col(batch_col) == batch))

    def _others_unchanged(self, before: DataFrame, staged: DataFrame, batch_col: str, batch: str) -> None:
        """All other rows of the touched partitions are staged exactly as they were."""
        old = fingerprints(before).first()
        new = fingerprints(staged.select(*before.columns).where(~F.col(batch_col).eqNullSafe(F.lit(batch)))).first()
        if tuple(old) != tuple(new):
            raise LoadError(f"rows of other batches would change: {tuple(old)} against {tuple(new)}")

    def replace_batch(self, batch: str, rows: DataFrame, expected_rows: int, batch_col: str = "batch_id", key: str | None = "event_id", operation: str = "replace_batch") -> Version:
        """Bring a batch to exactly ``rows``: what is there of it goes, rows of other batches stay as they are.

        Staged rows are counted against the manifest and checked for repeated keys and for other batches' content
        before the switch; a count that is off refuses the change and leaves the table as it was. Run again after a
        crash, it does the same work or finds it done."""
        base = self.version()
        schema = self._widened(base, rows, add_columns=False)
        rows = rows.select(*schema.names)
        if not rows.where(~F.col(batch_col).eqNullSafe(F.lit(batch))).isEmpty():
            raise LoadError(f"the rows to load are not all of batch {batch}")
        touched = sorted({*self._batch_partitions(base, batch_col, batch), *self._values(rows)}, key=str)
        others = self._other_rows(base, touched, batch_col, batch)

        def verify(staged: DataFrame) -> None:
            own = staged.where(F.col(batch_col) == batch)
            per_key = own.groupBy(*([key] if key else [])).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
            if (per_key["rows"] or 0) != expected_rows:
                raise LoadError(f"batch {batch}: {per_key['rows'] or 0} rows staged, the manifest has {expected_rows}")
            if key and (per_key["most"] or 0) > 1:
                raise LoadError(f"batch {batch}: a {key} stands more than once")
            self._others_unchanged(others, staged, batch_col, batch)

        detail = {"batch": batch, "expected_rows": expected_rows, "partitions": len(touched)}
        return self._replace(base, schema, touched, others.unionByName(rows), operation, detail, verify)

    def quarantine_batch(self, batch: str, batch_col: str = "batch_id") -> Version:
        """Take a batch out of the table: only partitions that hold it are rewritten. A batch that is not there changes nothing."""
        base = self.version()
        touched = self._batch_partitions(base, batch_col, batch)
        if not touched:
            return base
        others = self._other_rows(base, touched, batch_col, batch)
        verify = lambda staged: self._others_unchanged(others, staged, batch_col, batch)
        return self._replace(base, base.schema, touched, others, "quarantine_batch", {"batch": batch, "partitions": len(touched)}, verify)

    def rebuild_partition(self, value, rows: DataFrame) -> Version:
        """Replace one partition by ``rows``, all of which have to belong to it; the others keep their files."""
        base = self.version()
        value = None if value is None else str(value)
        schema = self._widened(base, rows, add_columns=False)
        return self._replace(base, schema, [value], rows, "rebuild_partition", {"value": value})

    def vacuum(self, keep_versions: int = 2) -> int:
        """Delete data that none of the last ``keep_versions`` versions names, their version files, and drafts of writers that
        died. Returns the number of folders deleted. Not to be run while a writer is at work."""
        files = self._version_files()
        kept = sorted(files)[-keep_versions:]
        named = {p["folder"] for n in kept for p in self.version(n).partitions.values()}
        fs, data = hadoop_path(self.spark, f"{self.path}/data")
        gone = 0
        for write in fs.listStatus(data) if fs.exists(data) else []:
            name = str(write.getPath().getName())
            parts = [str(s.getPath().getName()) for s in fs.listStatus(write.getPath()) if s.isDirectory()]
            alive = [p for p in parts if f"data/{name}/{p}" in named]
            for p in [f"data/{name}"] if not alive else [f"data/{name}/{p}" for p in parts if p not in alive]:
                self._discard(p)
                gone += 1
        for n in set(files) - set(kept):
            f, p = hadoop_path(self.spark, files[n])
            f.delete(p, False)
        return gone
