"""A catalog of Parquet tables under one root, with an operation for each command."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.functions.chunking import ChunkSizes
from cairnlake.operators import chunks, diff, integrity, listing, packs, prune, retention, stats
from cairnlake.schema import FILE, TABLES

#: Digests by the number in the configuration; 1 and 2 name the same function.
DIGESTS = {1: "fnv1a_128_lowprime", 2: "fnv1a_128_lowprime", 3: "blake2b_128"}


class Catalog:
    """Entries are partitioned by snapshot, so that reading one of them prunes the others. Any Hadoop path will do."""

    def __init__(self, spark: SparkSession, root: str, key: bytes | None = None):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}")

    def _write(self, name: str, rows: DataFrame, path: str, mode: str) -> None:
        out = rows.select(*(x.split()[0] for x in TABLES[name].split(", "))).write.mode(mode)
        (out.partitionBy("snapshot") if name == "entries" else out).parquet(path)

    def append(self, name: str, rows: DataFrame) -> None:
        self._write(name, rows, f"{self.root}/{name}", "append")

    def replace(self, name: str, rows: DataFrame) -> None:
        """A new version of a table, written in full before it takes the place of the old one."""
        new, old, here = (f"{self.root}/{x}" for x in (f"_new_{name}", f"_old_{name}", name))
        self._write(name, rows, new, "overwrite")
        fs, at = self._fs(here)
        path = lambda x: self._fs(x)[1]
        fs.delete(path(old), True)
        fs.rename(at, path(old))
        fs.rename(path(new), at)
        fs.delete(path(old), True)

    def create(self, **config) -> None:
        """Write empty tables; a root that already has a configuration is left alone."""
        fs, at = self._fs(f"{self.root}/repo_config")
        if fs.exists(at):
            return
        for name, schema in TABLES.items():
            if name == "repo_config":
                rows = self.spark.createDataFrame([tuple(config.get(c.split()[0]) for c in schema.split(", "))], schema)
                rows.write.parquet(f"{self.root}/{name}")
            else:
                fs.mkdirs(self._fs(f"{self.root}/{name}")[1])

    def config(self):
        return self.table("repo_config").first()

    def recovered_uuid(self) -> str | None:
        """The catalog's id by its first snapshot that names one, for where the configuration is lost."""
        got = self.table("snapshots").where("repo_uuid is not null").agg(F.min_by("repo_uuid", "name")).first()
        return got[0] if got else None

    def resolve(self, snapshot: str) -> str:
        """The name of a snapshot given by that name or a path that ends in it; prefixes are not looked up."""
        name = snapshot.rstrip("/").rsplit("/", 1)[-1]
        if self.table("snapshots").where(F.col("name") == name).isEmpty():
            raise LookupError(f"no snapshot {name}")
        return name

    def chunk(self, files: DataFrame, key: str = "path", data: str = "content") -> DataFrame:
        """(path, ord, chunk_id, payload) by the sizes and digest of the configuration."""
        c = self.config()
        sizes = ChunkSizes(c["chunk_min"] or 4096, c["chunk_avg"] or 32768, c["chunk_max"] or 262144)
        return chunks.content_chunks(files, key, data, sizes, DIGESTS.get(c["hash_algo"], "sha256"))

    def dedup(self, made: DataFrame) -> DataFrame:
        """The chunks that the index lacks, each once."""
        return chunks.new_chunks(made.select("chunk_id", "payload"), self.table("chunk_index"))

    def backup(self, files: DataFrame, snapshot: str, created_ns: int = 0, writers: int = 8, pack_bytes: int = packs.ROTATE_BYTES) -> DataFrame:
        """Add a snapshot of files (columns of entries beside snapshot and the lists of chunks, and content), and return its
        totals. Hard links and files that the cache knows are not read; new chunks are encoded, packed and indexed
        before the entries that name them are written."""
        rows = chunks.as_links(chunks.group_hardlinks(files.withColumn("snapshot", F.lit(snapshot)).withColumns({"chunks": F.lit(None).cast("array<string>"), "delta_source_chunks": F.lit(None).cast("array<string>")})))
        cache, index = self.table("file_cache"), self.table("chunk_index")
        known = chunks.cache_hits(rows, cache, index).join(cache.select("path", F.col("chunks").alias("cached")), "path")
        read = rows.where((F.col("type") == FILE) & ~F.col("is_link")).join(known, "path", "left_anti")
        staging = f"{self.root}/_staging"
        self.chunk(read).write.mode("overwrite").parquet(f"{staging}/chunks")
        made = self.spark.read.parquet(f"{staging}/chunks")
        level = self.config()["zstd_level"] or (3 if self.config()["compression"] else 0)
        stored = packs.encoded(self.dedup(made), max(0, min(level, 22)))
        stored = packs.sealed(stored, self.key) if self.key else stored
        first = (self.table("packs").agg(F.max("pack_id")).first()[0] or 0) + 1
        packs.packed(stored, first, writers, pack_bytes).write.mode("overwrite").parquet(f"{staging}/packs")
        new = self.spark.read.schema(packs.PACK).parquet(f"{staging}/packs")
        held = new.select("pack_id", F.inline("entries"))
        segment = (index.agg(F.max("segment_id")).first()[0] or 0) + 1
        self.append("packs", new)
        self.append("pack_entries", held)
        self.append("chunk_index", held.withColumn("segment_id", F.lit(segment).cast("long")))
        self.append("bloom_segments", packs.bloom(held.withColumn("segment_id", F.lit(segment).cast("long"))))
        lists = made.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "chunk_id"))), lambda x: x["chunk_id"]).alias("made"))
        entries = rows.drop("chunks").join(lists, "path", "left").join(known, "path", "left").withColumn("chunks", F.coalesce("made", "cached"))
        self.append("entries", entries)
        config = self.config()
        self.append("snapshots", self.spark.createDataFrame([(snapshot, snapshot, config["uuid"], created_ns, None, None)], TABLES["snapshots"]))
        self.replace("file_cache", self.entries(snapshot).where((F.col("type") == FILE) & F.col("hardlink_to").isNull()))
        fs, at = self._fs(staging)
        fs.delete(at, True)
        return stats.create_stats(self.entries(snapshot), self.index())

    def snapshots(self) -> DataFrame:
        return self.table("snapshots").orderBy("created_ns", "name")

    def entries(self, snapshot: str | None = None) -> DataFrame:
        rows = self.table("entries")
        return rows if snapshot is None else rows.where(F.col("snapshot") == snapshot)

    def index(self) -> DataFrame:
        return integrity.latest(self.table("chunk_index"))

    def ls(self, snapshot: str, prefix: str = "", recursive: bool = False) -> DataFrame:
        return (listing.listing if recursive else listing.panel)(self.entries(snapshot), prefix)

    def search(self, pattern: str, glob: bool | None = None, snapshot: str | None = None) -> DataFrame:
        return listing.search(self.entries(), pattern, glob, snapshot)

    def diff(self, old: str, new: str) -> DataFrame:
        return diff.snapshot_diff(self.entries(old), self.entries(new))

    def info(self) -> DataFrame:
        return stats.repo_info(stats.manifest_counters(self.entries()), self.index(), self.table("packs"))

    def retention(self, **policy: int) -> DataFrame:
        return retention.retain(self.table("snapshots").withColumn("ts", F.timestamp_seconds(F.floor(F.col("created_ns") / 1_000_000_000))), **policy)

    def prune_plan(self, **policy: int) -> DataFrame:
        kept = self.retention(**policy).where("keep").select(F.col("name").alias("snapshot"))
        live = prune.live_chunks(chunks.chunk_refs(self.entries()), kept)
        return prune.classify_packs(self.table("pack_entries"), live, self.table("packs"))

    def prune(self, writers: int = 8, **policy: int) -> DataFrame:
        """Drop the snapshots that the policy does not keep, the packs without live chunks, and the dead chunks of packs
        that are rewritten; returns packs and bytes before and after. New tables are written in full before old ones go."""
        kept = [r["name"] for r in self.retention(**policy).where("keep").select("name").collect()]  # names of snapshots only
        if not kept:
            raise ValueError("the policy keeps no snapshot")
        staging = f"{self.root}/_staging"
        plan = self.prune_plan(**policy).select("pack_id", "action")
        plan.write.mode("overwrite").parquet(f"{staging}/plan")
        plan = self.spark.read.parquet(f"{staging}/plan")
        held, old = self.table("pack_entries"), self.table("packs")
        before = old.select("pack_id", "bytes")
        before.write.mode("overwrite").parquet(f"{staging}/before")
        entries = self.entries().where(F.col("snapshot").isin(kept))
        live = chunks.chunk_refs(entries).select("chunk_id").distinct()
        rewritten = plan.where("action = 'rewrite'").select("pack_id")
        moved = held.join(rewritten, "pack_id", "left_semi").join(live, "chunk_id", "left_semi")
        raw = packs.sliced(old, moved)
        first = (old.agg(F.max("pack_id")).first()[0] or 0) + 1
        packs.packed(raw.where("stored is not null").dropDuplicates(["chunk_id"]), first, writers).write.mode("overwrite").parquet(f"{staging}/packs")
        new = self.spark.read.schema(packs.PACK).parquet(f"{staging}/packs")
        stay = plan.where("action = 'keep'").select("pack_id")
        both = held.join(stay, "pack_id", "left_semi").select("pack_id", "chunk_id", "offset", "comp_size", "uncomp_size", "flags").unionByName(new.select("pack_id", F.inline("entries")))
        both.write.mode("overwrite").parquet(f"{staging}/entries")
        both = self.spark.read.parquet(f"{staging}/entries")
        segment = (self.table("chunk_index").agg(F.max("segment_id")).first()[0] or 0) + 1
        index = both.join(live, "chunk_id", "left_semi").dropDuplicates(["chunk_id"]).withColumn("segment_id", F.lit(segment).cast("long"))
        self.replace("packs", old.join(stay, "pack_id", "left_semi").unionByName(new.drop("entries")))
        self.replace("pack_entries", both)
        self.replace("chunk_index", index)
        self.replace("bloom_segments", packs.bloom(index))
        self.replace("entries", entries)
        self.replace("snapshots", self.table("snapshots").where(F.col("name").isin(kept)))
        out = self.spark.createDataFrame(prune.prune_stats(self.spark.read.parquet(f"{staging}/before"), self.table("packs")).collect())  # one row
        fs, at = self._fs(staging)
        fs.delete(at, True)
        return out

    def payloads(self) -> DataFrame:
        """(chunk_id, pack_id, uncomp_size, payload) of all indexed chunks."""
        return packs.unpacked(self.table("packs"), self.index(), self.key)

    def verify(self, fast: bool = False) -> DataFrame:
        """(category, n): references without a chunk or pack, packs with a wrong checksum, and chunks that are out of bounds,
        cannot be decoded, or differ from their size or id. fast leaves out what reads payloads."""
        refs, index = chunks.chunk_refs(self.entries()), self.index()
        checks = {"missing_chunks": integrity.missing_refs(refs, index, "chunk_id"), "missing_packs": integrity.refs_to_missing_packs(refs, index, self.table("packs"))}
        if not fast:
            algo = DIGESTS.get(self.config()["hash_algo"], "sha256")
            checks |= {"damaged_packs": integrity.damaged_packs(self.table("packs")), "damaged_chunks": integrity.damaged_chunks(self.payloads(), algo)}
        return integrity.health(checks)

    def health(self) -> DataFrame:
        refs, index, all_, held = chunks.chunk_refs(self.entries()), self.index(), self.table("packs"), self.table("pack_entries")
        return integrity.health({
            "missing_chunks": integrity.missing_refs(refs, index, "chunk_id"), "missing_packs": integrity.refs_to_missing_packs(refs, index, all_), "orphan_segments": integrity.orphan_segments(index, all_),
            "indexless_packs": integrity.indexless_packs(held, all_, index), "orphan_filters": integrity.orphan_filters(self.table("bloom_segments"), index), "damaged_packs": integrity.damaged_packs(all_),
        })

    def repair_index(self) -> None:
        """Append a segment with what packs hold and the index lacks; nothing is deleted."""
        index = self.table("chunk_index")
        segment = (index.agg(F.max("segment_id")).first()[0] or 0) + 1
        self.append("chunk_index", integrity.rebuilt_index(self.table("pack_entries"), index, segment))

    def repair(self) -> DataFrame:
        """Set damaged packs aside in the table `damaged`, drop orphan segments and filters and the index rows of packs that
        are gone, index what the packs hold, and report health again."""
        bad = self.table("packs").join(integrity.damaged_packs(self.table("packs")), "pack_id", "left_semi")
        self._write("packs", bad, f"{self.root}/damaged", "append")
        gone = self.spark.read.schema(TABLES["packs"]).parquet(f"{self.root}/damaged").select("pack_id").distinct()
        self.replace("packs", self.table("packs").join(gone, "pack_id", "left_anti"))
        self.replace("pack_entries", self.table("pack_entries").join(self.table("packs").select("pack_id"), "pack_id", "left_semi"))
        index = self.table("chunk_index")
        self.replace("chunk_index", index.join(self.table("packs").select("pack_id"), "pack_id", "left_semi").join(integrity.orphan_segments(index, self.table("packs")), "segment_id", "left_anti"))
        self.repair_index()
        filters = self.table("bloom_segments")
        self.replace("bloom_segments", filters.join(integrity.orphan_filters(filters, self.table("chunk_index")).select("segment_id"), "segment_id", "left_anti"))
        return self.health()

    def restore(self, snapshot: str, payloads: DataFrame | None = None, patterns: list[str] | None = None) -> DataFrame:
        """(path, type, mode, mtime_ns, symlink_target, data, missing) of the entries, or of those that match; hard links get the
        bytes of the file that they point to. A path of the snapshot that leaves its root stops it."""
        from cairnlake.functions.match import extract_matches
        from cairnlake.functions.scalars import is_safe_relative_path

        every = self.entries(snapshot)
        unsafe = every.where(~is_safe_relative_path(F.col("path"))).select("path").first()
        if unsafe:
            raise ValueError(f"unsafe path in snapshot: {unsafe[0]}")
        wanted = every.where(extract_matches(F.col("path"), patterns)) if patterns else every
        own = wanted.select("path", "type", "mode", "mtime_ns", "symlink_target", F.coalesce("hardlink_to", "path").alias("from"))
        rows = every.where(F.col("type") == FILE)
        refs = rows.join(own.select(F.col("from").alias("path")).distinct(), "path", "left_semi").select("path", F.posexplode("chunks").alias("ord", "chunk_id"))
        data = chunks.reconstruct(refs, self.payloads() if payloads is None else payloads, "path").withColumnRenamed("path", "from")
        file = F.col("type") == FILE
        out = own.join(data, "from", "left")
        return out.select("path", "type", "mode", "mtime_ns", "symlink_target", F.when(file, F.coalesce("data", F.lit(b""))).alias("data"), F.coalesce("missing", F.lit(0)).alias("missing"))

    def register_views(self, prefix: str = "") -> None:
        """Temporary views of all tables, for SQL."""
        for name in TABLES:
            self.table(name).createOrReplaceTempView(f"{prefix}{name}")
