"""Registered queries: each operator over a whole driver table that stands in for a catalog.

documents: files (path = source/lang/id, chunks = the text); lineitem: chunk references (orders: the index, customers:
the packs) and, by ship date, versions of parts; orders: snapshots by date; pages: a tree of paths. What a fixture lacks
(a missing pack, a stale index) is read off a column, as each docstring says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.functions import chunking, hashing, match, scalars
from cairnlake.operators import chunks, diff, integrity, listing, packs, prune, retention, stats

SMALL = chunking.ChunkSizes(64, 256, 1024)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _document_entries(spark, sf_dir) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("snapshot"), F.concat_ws("/", "source", "lang", "doc_id").alias("path"), F.when(F.col("lang") == "en", 2).when(F.col("lang") == "de", 3).otherwise(1).alias("type"),
        F.lit(0).alias("flags"), F.octet_length("text").cast("long").alias("size"), F.when(F.length("text") > 0, F.array(F.md5(F.col("text").cast("binary")))).alias("chunks"),
    )


def _part_version(spark, sf_dir, until: str) -> DataFrame:
    """Parts as last shipped before a date, those then returned being gone."""
    rows = _t(spark, sf_dir, "lineitem").where(F.col("l_shipdate") < F.lit(until).cast("timestamp_ntz"))
    newest = rows.groupBy("l_partkey").agg(F.max(F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")).alias("v")).where("v.l_returnflag <> 'R'")
    none = F.lit(None).cast("string")
    return newest.select(
        F.concat(F.lit("part/"), "l_partkey").alias("path"), F.when(F.col("v.l_returnflag") == "A", 3).otherwise(2).alias("type"), F.col("v.l_linenumber").alias("mode"), F.lit(0).alias("uid"), F.lit(0).alias("gid"),
        F.col("v.l_quantity").cast("long").alias("size"), F.unix_date(F.col("v.l_shipdate").cast("date")).alias("mtime_ns"), F.col("v.l_suppkey").cast("string").alias("symlink_target"), none.alias("hardlink_to"), F.array(F.col("v.l_suppkey").cast("string")).alias("chunks"),
    )


def _refs(spark, sf_dir) -> DataFrame:
    """A reference for each line item; its status is its snapshot."""
    return _t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("snapshot"), F.col("l_orderkey").alias("chunk_id"), "l_linenumber")


def _index(spark, sf_dir) -> DataFrame:
    """Orders that are not pending; the customer is the pack, the priority the segment."""
    o = _t(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    return o.select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("pack_id"), F.substring("o_orderpriority", 1, 1).cast("long").alias("segment_id"), F.floor("o_totalprice").cast("long").alias("comp_size"))


def _packs(spark, sf_dir) -> DataFrame:
    """Customers without debts; bytes are the whole part of their orders."""
    c = _t(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("pack_id"))
    return c.join(_index(spark, sf_dir).groupBy("pack_id").agg(F.sum("comp_size").alias("bytes")), "pack_id")


def snapshot_diff(spark, sf_dir):
    """Every third size stands for a file without chunks: its list is null in the one version and empty in the other."""
    bare = lambda df, none: df.withColumn("chunks", F.when(F.col("size") % 3 == 0, none).otherwise(F.col("chunks")))
    old, new = bare(_part_version(spark, sf_dir, "1997-01-01"), F.lit(None).cast("array<string>")), bare(_part_version(spark, sf_dir, "1998-06-01"), F.array().cast("array<string>"))
    return diff.snapshot_diff(old, new)


def snapshot_diff_summary(spark, sf_dir):
    return diff.diff_summary(snapshot_diff(spark, sf_dir))


def _order_snapshots(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name"), F.col("o_orderdate").alias("ts"))


def _retention(**policy):
    def query(spark, sf_dir):
        return retention.retain(_order_snapshots(spark, sf_dir), **policy).where("keep").select("name", "ts")

    return query


def retention_dry_run(spark, sf_dir):
    return prune.dry_run(retention.retain(_order_snapshots(spark, sf_dir), last=5, daily=7, weekly=4, monthly=12, yearly=3))


def manifest_counters(spark, sf_dir):
    return stats.manifest_counters(_document_entries(spark, sf_dir))


def repo_info(spark, sf_dir):
    """Documents as entries, orders as the index (price with and without tax as sizes), customers as packs."""
    index = _index(spark, sf_dir).withColumn("uncomp_size", F.col("comp_size") * 2).withColumn("flags", F.col("segment_id").cast("int"))
    return stats.repo_info(manifest_counters(spark, sf_dir), index, _packs(spark, sf_dir))


def create_stats(spark, sf_dir):
    """The chunks of documents are their texts; each is stored once, in as many bytes as it has characters."""
    entries = _document_entries(spark, sf_dir).withColumn("type", F.lit(2))
    index = _t(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("chunk_id"), F.col("n_chars").alias("comp_size")).groupBy("chunk_id").agg(F.max("comp_size").alias("comp_size"))
    return stats.create_stats(entries, index).select("input_bytes", "output_bytes", F.round("saved", 2).alias("saved"))


def pack_stats(spark, sf_dir):
    return stats.pack_stats(_packs(spark, sf_dir))


def hardlink_groups(spark, sf_dir):
    """Documents with one text are links of one file on two devices; German ones are directories, every seventh length
    has no inode number; the canonical one has the smallest path."""
    ino = F.when(F.col("n_chars") % 7 == 0, "0").otherwise(F.md5(F.col("text").cast("binary")))
    d = _t(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path"), F.when(F.col("lang") == "de", 1).otherwise(2).alias("type"), (F.col("doc_id") % 2).alias("dev"), ino.alias("ino"))
    return chunks.group_hardlinks(d).where("canonical is not null").select("path", "canonical", "is_link")


def _pages(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"), F.lit(2).alias("type"), F.octet_length("html").cast("long").alias("size"))


def search_substring(spark, sf_dir):
    return listing.search(_pages(spark, sf_dir), "e.com/d", glob=False).select("page_id", "path")


def search_glob(spark, sf_dir):
    return listing.search(_pages(spark, sf_dir), "*/*/*[0-9]").select("page_id", "path")


def search_totals(spark, sf_dir):
    rows = _document_entries(spark, sf_dir)
    return rows.agg(F.count_if(match.search_matches(F.col("path"), "*/en/?[0-4]*")).alias("matches"), F.count_distinct("snapshot").alias("scanned"))


def ls_contains(spark, sf_dir):
    return _pages(spark, sf_dir).where(match.contains_ignoring_case(F.col("path"), "EXAMPLE")).select("page_id", "path")


def ls_children(spark, sf_dir):
    return listing.children(_document_entries(spark, sf_dir), "/src0/")


def ls_prefix(spark, sf_dir):
    return listing.listing(_document_entries(spark, sf_dir), "src0/en/").select("path", "size")


def tree_sizes(spark, sf_dir):
    return listing.tree_sizes(_document_entries(spark, sf_dir))


def extract_match(spark, sf_dir):
    return _document_entries(spark, sf_dir).where(match.extract_matches(F.col("path"), ["src1/", "src2/*/1*"])).select("path")


def cache_hits(spark, sf_dir):
    """Parts of two dates as entries and cache; a chunk is known if its supplier is not in debt."""
    add = lambda df: df.withColumn("dev", F.lit(1)).withColumn("ino", F.lit(1)).withColumn("ctime_ns", F.col("mtime_ns"))
    known = _t(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").cast("string").alias("chunk_id"))
    return chunks.cache_hits(add(_part_version(spark, sf_dir, "1998-06-01")), add(_part_version(spark, sf_dir, "1997-01-01")), known)


def stale_cache(spark, sf_dir):
    known = _t(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").cast("string").alias("chunk_id"))
    return chunks.stale_cache(_part_version(spark, sf_dir, "1998-06-01"), known)


def missing_index_refs(spark, sf_dir):
    return integrity.missing_refs(_refs(spark, sf_dir), _index(spark, sf_dir), "chunk_id").groupBy("snapshot").agg(F.count("*").alias("missing"))


def missing_pack_refs(spark, sf_dir):
    return integrity.refs_to_missing_packs(_refs(spark, sf_dir), _index(spark, sf_dir), _packs(spark, sf_dir)).groupBy("snapshot").agg(F.count("*").alias("missing"))


def orphan_segments(spark, sf_dir):
    """Each order date is a segment; a segment is an orphan if no order of that date is in an existing pack."""
    o = _t(spark, sf_dir, "orders").select(F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("segment_id"), F.col("o_custkey").alias("pack_id"))
    return integrity.orphan_segments(o, _packs(spark, sf_dir)).select("segment_id")


def indexless_packs(spark, sf_dir):
    """Parts as packs of the suppliers that ship them; the index knows suppliers with little money."""
    held = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("pack_id"), F.col("l_suppkey").alias("chunk_id"))
    index = _t(spark, sf_dir, "supplier").where("s_acctbal < 500").select(F.col("s_suppkey").alias("chunk_id"), F.lit(-1).cast("long").alias("pack_id"))
    return integrity.indexless_packs(held, _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("pack_id")), index)


def rebuilt_index(spark, sf_dir):
    held = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("pack_id"))
    return integrity.rebuilt_index(held, _index(spark, sf_dir), 99).select("chunk_id", "pack_id", "segment_id")


def latest_index(spark, sf_dir):
    """The last line item of a part wins."""
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("chunk_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("segment_id"), F.col("l_suppkey").alias("pack_id"))
    return integrity.latest(rows).select("chunk_id", "segment_id", "pack_id")


def health_report(spark, sf_dir):
    refs, index, packs = _refs(spark, sf_dir), _index(spark, sf_dir), _packs(spark, sf_dir)
    return integrity.health({"missing_chunks": integrity.missing_refs(refs, index, "chunk_id"), "missing_packs": integrity.refs_to_missing_packs(refs, index, packs)})


def _live(spark, sf_dir):
    kept = spark.createDataFrame([("N",)], "snapshot string")
    return prune.live_chunks(_refs(spark, sf_dir), kept)


def live_set(spark, sf_dir):
    return _live(spark, sf_dir)


def dead_chunks(spark, sf_dir):
    return prune.dead_chunks(_index(spark, sf_dir), _live(spark, sf_dir)).select("chunk_id", "pack_id")


def _held(spark, sf_dir):
    """What packs hold: all orders, those that the index lacks too."""
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("pack_id"), F.floor("o_totalprice").cast("long").alias("comp_size"))


def _all_packs(spark, sf_dir):
    """Customers without debts, those without orders being empty packs."""
    held = _held(spark, sf_dir).groupBy("pack_id").agg(F.sum("comp_size").alias("bytes"))
    c = _t(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("pack_id"))
    return c.join(held, "pack_id", "left").fillna(0, ["bytes"])


def _classified(spark, sf_dir):
    return prune.classify_packs(_held(spark, sf_dir), _live(spark, sf_dir), _all_packs(spark, sf_dir))


def pack_classify(spark, sf_dir):
    return _classified(spark, sf_dir).drop("bytes")


def prune_totals(spark, sf_dir):
    """Of all packs that have an id."""
    return prune.planned_stats(_classified(spark, sf_dir).where("pack_id is not null"))


def pack_rotation(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return packs.rotation(d, "doc_id", "n_chars", "source", 20_000).select("doc_id", "pack")


def pack_round_trip(spark, sf_dir):
    """Distinct texts encoded, packed, found by the entries of the packs and decoded again. There are as many writers as
    partitions of a shuffle, so that a writer's share does not grow with the table where these do."""
    d = _t(spark, sf_dir, "documents").where("text is not null").select(F.md5(F.col("text").cast("binary")).alias("chunk_id"), F.col("text").cast("binary").alias("payload")).dropDuplicates(["chunk_id"])
    made = packs.packed(packs.encoded(d), 1, writers=int(spark.conf.get("spark.sql.shuffle.partitions")), limit=1 << 20)
    back = packs.unpacked(made)
    return back.select("chunk_id", F.decode("payload", "utf-8").alias("text"))


def bloom_lookup(spark, sf_dir):
    """Every segment of the filters of suppliers' digests lets its own ids through: none of them is lost."""
    ids = _t(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 3).alias("segment_id"), F.md5(F.col("s_suppkey").cast("string").cast("binary")).alias("chunk_id"))
    got = packs.may_hold(packs.bloom(ids, bits=1 << 16), ids)
    return got.join(ids, ["chunk_id", "segment_id"], "left_semi").groupBy("segment_id").agg(F.count("*").alias("n"))


def scalar_functions(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    ns = F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000
    name = scalars.snapshot_name(F.col("o_orderpriority"), ns, F.md5(F.col("o_orderkey").cast("string").cast("binary")))
    return o.select(
        "o_orderkey", scalars.format_bytes(F.floor(F.col("o_totalprice") * F.col("o_custkey"))).alias("size_text"), scalars.format_timestamp_utc(ns).alias("time_text"), name.alias("name"),
        scalars.parse_snapshot_timestamp(name).alias("parsed"), scalars.is_safe_relative_path(F.concat(F.when(F.col("o_orderkey") % 4 == 0, "../").when(F.col("o_orderkey") % 4 == 1, "/").when(F.col("o_orderkey") % 4 == 2, "a/../").otherwise("a/"), name)).alias("safe"), scalars.to_hex(F.col("o_orderstatus").cast("binary")).alias("status_hex"),
    )


def fnv1a64(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("source").distinct()
    return d.select("source", hashing.fnv1a_64(F.col("source").cast("binary")).alias("digest"))


def digests(spark, sf_dir):
    raw = F.col("text").cast("binary")
    return _t(spark, sf_dir, "benchmark").select("item_id", hashing.crc32c(raw).alias("crc32c"), F.hex(hashing.blake2b_128(raw)).alias("blake2b_128"), F.hex(hashing.fnv1a_128_lowprime(raw)).alias("fnv1a_128_lowprime"))


def fixed_block_dedup(spark, sf_dir):
    pieces = chunks.fixed_chunks(_t(spark, sf_dir, "documents"), "doc_id", "text", 256)
    ids = pieces.groupBy(F.md5(F.col("piece").cast("binary")).alias("id")).agg(F.count("*").alias("n"))
    return ids.agg(F.sum("n").alias("refs"), F.count("*").alias("unique_chunks")).withColumn("ratio", stats.ratio(F.col("refs"), F.col("unique_chunks")))


def cdc_chunks(spark, sf_dir):
    return chunks.content_chunks(_t(spark, sf_dir, "documents"), "doc_id", "text", SMALL).select("doc_id", "ord", "chunk_id", F.length("payload").alias("bytes"))


def cdc_dedup(spark, sf_dir):
    ids = cdc_chunks(spark, sf_dir).groupBy("chunk_id").agg(F.count("*").alias("n"))
    return ids.agg(F.sum("n").alias("refs"), F.count("*").alias("unique_chunks")).withColumn("ratio", stats.ratio(F.col("refs"), F.col("unique_chunks")))


def reconstruct(spark, sf_dir):
    """Documents cut into content-defined chunks, stored once each, and put together again."""
    rows = chunks.content_chunks(_t(spark, sf_dir, "documents"), "doc_id", "text", SMALL)
    stored = rows.dropDuplicates(["chunk_id"]).select("chunk_id", "payload")
    back = chunks.reconstruct(rows.select("doc_id", "ord", "chunk_id"), stored, "doc_id")
    return back.select("doc_id", F.decode("data", "utf-8").alias("text"), "missing")


def damaged_chunks(spark, sf_dir):
    rows = chunks.content_chunks(_t(spark, sf_dir, "documents"), "doc_id", "text", SMALL)
    return integrity.damaged_chunks(rows.select("chunk_id", F.overlay("payload", F.lit(b"X"), F.lit(1)).alias("payload"))).groupBy().agg(F.count("*").alias("damaged"))


def entropy_class(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.groupBy(chunking.is_incompressible(F.col("text").cast("binary")).alias("incompressible")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (snapshot_diff, snapshot_diff_summary, retention_dry_run, manifest_counters, repo_info, create_stats, pack_stats, hardlink_groups, search_substring, search_glob, search_totals, ls_contains, ls_children, ls_prefix, tree_sizes, extract_match, cache_hits, stale_cache, missing_index_refs, missing_pack_refs, orphan_segments, indexless_packs, rebuilt_index, latest_index, health_report, live_set, dead_chunks, pack_classify, prune_totals, pack_rotation, pack_round_trip, bloom_lookup, scalar_functions, fnv1a64, digests, fixed_block_dedup, cdc_chunks, cdc_dedup, reconstruct, damaged_chunks, entropy_class)
} | {
    "retention_last": _retention(last=25), "retention_daily": _retention(daily=14), "retention_weekly": _retention(weekly=20), "retention_monthly": _retention(monthly=18), "retention_yearly": _retention(yearly=4),
    "retention_union": _retention(last=5, daily=7, weekly=4, monthly=12, yearly=3),
}
