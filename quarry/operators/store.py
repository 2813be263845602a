"""The chunk index on disk: buckets by the hash of a key, versions by a manifest that is written last, a catalog kept for each bucket, and paging.

An upsert rewrites the buckets that its keys fall into and no others, into a folder of its own; then a manifest names each bucket's folder. Readers see the
last manifest only, so a writer that dies before leaves nothing but files that no manifest names. A manifest's number is taken once: of two writers that
began at the same version the second is told so and starts again from the new one. A manifest keeps each source's last batch, so a batch that runs again
is skipped. With each bucket stands the part of the catalog that its chunks make, so the catalog is merged from small tables without reading chunks.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 32
#: Columns of a store that nothing was written to.
EMPTY = {
    "chunks": "chunk_id string, source_doc_id string, filename string, chunk_index int, chunk_kind string, schema_version int",
    "catalog": "doc_id string, kind string, n long, most int, first struct<chunk_id:string,filename:string>, versions array<int>",
}


class Conflict(RuntimeError):
    """Another writer has published the next version."""


class ChunkStore:
    """An index of chunk rows under `root`; `key` names the column whose values are replaced as a whole (a file's name)."""

    def __init__(self, spark: SparkSession, root: str, key: str = "filename", buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))

    # -- versions

    def _numbers(self) -> list[int]:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/manifest"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, number: int | None = None) -> dict:
        """The manifest of a version, of the last one if none is named."""
        numbers = self._numbers() if number is None else [number]
        if not numbers:
            return {"version": 0, "buckets": {}, "batches": {}, "schema": None}
        text = "".join(r["value"] for r in self.spark.read.text(f"{self.root}/manifest/{numbers[-1]:010d}.json", wholetext=True).collect())
        return json.loads(text)

    def _announce(self, made: dict) -> None:
        """Writes the manifest beside its place and moves it there, which fails if the place is taken."""
        jvm, ahead = self.spark._jvm, self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(ahead, False)
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        place = self._path(f"{self.root}/manifest/{made['version']:010d}.json")
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri() if place.toUri().getScheme() else self._fs.getUri(), self._conf).rename(self._fs.makeQualified(ahead), self._fs.makeQualified(place), options)
        except Exception as e:
            if "already exists" in str(e) or "AlreadyExists" in str(e):
                raise Conflict(f"version {made['version']} was published by another writer") from e
            raise

    # -- reading

    def _read(self, made: dict, kind: str, buckets: list[int] | None = None) -> DataFrame:
        chosen = [v[kind] for k, v in made["buckets"].items() if buckets is None or int(k) in buckets]
        schema = (made["schema"] or EMPTY)[kind]
        if not chosen:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*sorted(chosen))

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.manifest(version), "chunks")

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def get(self, value: str) -> DataFrame:
        """The chunks of one key, in order; only its bucket is read."""
        bucket = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(value)), F.lit(self.buckets)).cast("int").alias("b")).first()["b"]
        return self._read(self.manifest(), "chunks", [bucket]).where(F.col(self.key) == value).orderBy("chunk_index")

    def catalog(self) -> DataFrame:
        """(doc_id, filename, chunks, max_chunk_index, chunk_kind_counts, schema_versions), merged from the buckets' parts."""
        parts = self._read(self.manifest(), "catalog")
        per_kind = parts.groupBy("doc_id", "kind").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.min("first").alias("first"), F.array_distinct(F.flatten(F.collect_list("versions"))).alias("versions"))
        return per_kind.groupBy("doc_id").agg(
            F.min("first").alias("first"), F.sum("n").alias("chunks"), F.max("most").alias("max_chunk_index"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("chunk_kind_counts"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("versions")))).alias("schema_versions"),
        ).select("doc_id", F.col("first.filename").alias("filename"), "chunks", "max_chunk_index", "chunk_kind_counts", "schema_versions")

    # -- writing

    def _parts(self, rows: DataFrame) -> DataFrame:
        """What the chunks of a bucket add to the catalog."""
        told = rows.select("_bucket", F.coalesce("source_doc_id", F.lit("unknown")).alias("doc_id"), F.coalesce("filename", F.lit("unknown")).alias("filename"), "chunk_index", F.coalesce("chunk_kind", F.lit("text")).alias("kind"), "schema_version", "chunk_id")
        return told.groupBy("_bucket", "doc_id", "kind").agg(F.count("*").alias("n"), F.max("chunk_index").alias("most"), F.min(F.struct("chunk_id", "filename")).alias("first"), F.array_sort(F.collect_set("schema_version")).alias("versions"))

    def _publish(self, made: dict, rows: DataFrame, touched: list[int], source: str, batch: int) -> int:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        rows = rows.withColumn("_bucket", self._bucket())
        # A bucket is written by as many tasks as its rows are worth, so that a large file is no single task's.
        rows.repartition("_bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).write.partitionBy("_bucket").parquet(f"{folder}/chunks")
        written = self.spark.read.parquet(f"{folder}/chunks") if self._fs.exists(self._path(f"{folder}/chunks/_SUCCESS")) and self._any(f"{folder}/chunks") else None
        now = {k: v for k, v in made["buckets"].items() if int(k) not in touched}
        schema = made["schema"]
        if written is not None:
            parts = self._parts(written)
            parts.write.partitionBy("_bucket").parquet(f"{folder}/catalog")
            schema = {"chunks": rows.drop("_bucket").schema.toDDL(), "catalog": parts.drop("_bucket").schema.toDDL()}
            for r in written.select("_bucket").distinct().collect():
                now[str(r["_bucket"])] = {kind: f"{folder}/{kind}/_bucket={r['_bucket']}" for kind in ("chunks", "catalog")}
        batches = made["batches"] | ({source: batch} if source else {})
        self._announce({"version": made["version"] + 1, "buckets": now, "batches": batches, "schema": schema})
        return made["version"] + 1

    def _any(self, folder: str) -> bool:
        return any(f.isDirectory() for f in self._fs.listStatus(self._path(folder)))

    def upsert(self, new: DataFrame, source: str = "", batch: int = 0) -> int:
        """Publishes a version in which new's keys have new's chunks, and returns its number. A batch of the source that stands in the manifest
        already changes nothing. Raises Conflict if another writer was first."""
        made = self.manifest()
        if source and made["batches"].get(source, -1) >= batch:
            return made["version"]
        touched = [r["b"] for r in new.select(self._bucket().alias("b")).distinct().collect()]
        if made["schema"] is None:
            return self._publish(made, new, touched, source, batch)
        old = self._read(made, "chunks", touched)
        kept = old.join(new.select(self.key).distinct(), self.key, "left_anti")
        return self._publish(made, kept.select(*old.columns).unionByName(new.select(*old.columns)), touched, source, batch)

    def delete(self, keys: DataFrame) -> int:
        """Publishes a version without the keys' chunks (keys: a table with the key's column)."""
        made = self.manifest()
        if made["schema"] is None:
            return made["version"]
        touched = [r["b"] for r in keys.select(self._bucket().alias("b")).distinct().collect()]
        old = self._read(made, "chunks", touched)
        return self._publish(made, old.join(keys.select(self.key).distinct(), self.key, "left_anti").select(*old.columns), touched, "", 0)

    def retried(self, change, tries: int = 5) -> int:
        """change(self) again from the newest version, as long as others are first."""
        for _ in range(tries - 1):
            try:
                return change(self)
            except Conflict:
                continue
        return change(self)

    def unnamed(self) -> list[str]:
        """Folders of data that the last manifest does not name: of older versions, and of writers that died."""
        named = {v["chunks"].split("/chunks/")[0].rsplit("/", 1)[1] for v in self.manifest()["buckets"].values()}
        data = self._path(f"{self.root}/data")
        return sorted(f.getPath().toString() for f in (self._fs.listStatus(data) if self._fs.exists(data) else []) if f.getPath().getName() not in named)


class PagedTable:
    """A table sorted by a unique id over files, with each file's bounds: a page is read from the files that hold it."""

    def __init__(self, rows: DataFrame, root: str, key: str = "point_id", files: int | None = None) -> None:
        self.spark, self.root, self.key = rows.sparkSession, f"{root.rstrip('/')}/{uuid.uuid4().hex}", key
        n = files or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows.repartitionByRange(n, key).sortWithinPartitions(key).write.parquet(self.root)
        self.table = self.spark.read.schema(rows.schema).parquet(self.root)
        found = self.table.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("n"))
        #: One row a file: a bounded list.
        self.bounds = [(r["file"], r["low"], r["high"], r["n"]) for r in found.orderBy("low").collect()]

    def page(self, token: str | None = None, size: int = 256) -> tuple[DataFrame, str | None, list[str]]:
        """(rows of the page in order, the token of the next page or None, files that were read)."""
        files, rows = [], 0
        for file, _, high, n in self.bounds:
            if token is None or high > token:
                files.append(file)
                # The first file may hold rows before the token, so its count says nothing.
                rows += n if len(files) > 1 or token is None else 0
                if rows > size:
                    break
        if not files:
            return self.table.limit(0), None, []
        held = self.spark.read.schema(self.table.schema).parquet(*files)
        ahead = held.where(F.col(self.key) > token) if token is not None else held
        found = ahead.orderBy(self.key).limit(size + 1)
        ids = [r[0] for r in found.select(self.key).collect()]
        more = len(ids) > size
        page = ahead.where(F.col(self.key) <= ids[min(size, len(ids)) - 1]).orderBy(self.key) if ids else held.limit(0)
        return page, ids[size - 1] if more else None, files

    def tokens(self, size: int = 256) -> DataFrame:
        """(page, token): the last id of every full page that another follows, at once: places within a file go on from the rows of the files before it."""
        before, offsets = 0, []
        for file, _, _, n in self.bounds:
            offsets.append((file, before))
            before += n
        starts = F.broadcast(self.spark.createDataFrame(offsets, "file string, before long"))  # one row a file
        placed = self.table.select(self.key, F.col("_metadata.file_path").alias("file")).join(starts, "file")
        place = F.col("before") + F.row_number().over(Window.partitionBy("file").orderBy(self.key))
        return placed.withColumn("place", place).where((F.col("place") % size == 0) & (F.col("place") < before)).select((F.col("place") / size).cast("long").alias("page"), F.col(self.key).alias("token"))
