"""Catalog operators against plain Python on small tables."""

import datetime as dt
import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from cairnlake.functions import chunking, hashing, match, scalars
from cairnlake.operators import chunks, diff, integrity, listing, packs, prune, retention
from cairnlake.sources import catalog

ENTRY = "path string, type int, mode int, uid long, gid long, size long, mtime_ns long, symlink_target string, hardlink_to string, chunks array<string>"


def test_diff_statuses(spark):
    base = [("same", 2, 1, 0, 0, 5, 9, None, None, ["a"]), ("gone", 2, 1, 0, 0, 5, 9, None, None, ["a"]), ("type", 2, 1, 0, 0, 5, 9, None, None, ["a"]), ("order", 2, 1, 0, 0, 5, 9, None, None, ["a", "b"]), ("meta", 2, 1, 0, 0, 5, 9, None, None, ["a"]), ("dir", 1, 1, 0, 0, 5, 9, None, None, None), ("link", 3, 1, 0, 0, 5, 9, "x", None, None), ("hard", 2, 1, 0, 0, 5, 9, None, "same", None)]
    new = [base[0], ("type", 3, 1, 0, 0, 5, 9, "t", None, None), ("order", 2, 1, 0, 0, 5, 9, None, None, ["b", "a"]), ("meta", 2, 2, 0, 0, 5, 9, None, None, ["a"]), ("dir", 1, 1, 0, 0, 7, 9, None, None, None), ("link", 3, 1, 0, 0, 5, 9, "y", None, None), ("hard", 2, 1, 0, 0, 6, 9, None, "same", None), ("added", 2, 1, 0, 0, 5, 9, None, None, [])]
    got = {r.path: r.status for r in diff.snapshot_diff(spark.createDataFrame(base, ENTRY), spark.createDataFrame(new, ENTRY)).collect()}
    assert got == {"same": "=", "gone": "D", "type": "T", "order": "M", "meta": "C", "dir": "=", "link": "M", "hard": "=", "added": "A"}


def test_retention_follows_the_loop(spark):
    rng = random.Random(4)
    rows = sorted({(dt.datetime(2020, 2, 27) + dt.timedelta(hours=rng.randrange(0, 14000)), i) for i in range(60)} | {(dt.datetime(2021, 1, 3), 99), (dt.datetime(2021, 1, 3), 98), (dt.datetime(2020, 2, 29), 97)})
    df = spark.createDataFrame([(str(n), t) for t, n in rows], "name string, ts timestamp")
    keys = {"daily": lambda t: t.date(), "weekly": lambda t: t.isocalendar()[:2], "monthly": lambda t: (t.year, t.month), "yearly": lambda t: t.year}
    newest = sorted(((t, str(n)) for t, n in rows), reverse=True)
    for policy in ({"last": 3}, {"daily": 5, "yearly": 1}, {"last": 1, "weekly": 4, "monthly": 3}, {"last": -1}, {"weekly": 9}):
        want = set(newest[: policy["last"]] if policy.get("last", 0) >= 0 else newest) if "last" in policy else set()
        for name, key in keys.items():
            seen = []
            for t, n in newest:
                if key(t) not in seen and len(seen) < policy.get(name, 0):
                    seen.append(key(t))
                    want.add((t, n))
        got = {r.name for r in retention.retain(df, **policy).where("keep").collect()}
        assert got == {n for _, n in want}, policy


def test_globs(spark):
    cases = [("*", ".a", True, True, False), ("*", "a/b", True, True, False), ("*", "a/b", False, False, True), ("a/*", "a/.b", True, True, False), ("a/*", "a/.b", False, True, True), ("[!a]x", "bx", True, True, True), ("[!a]x", "ax", True, True, False), ("a\\*", "a\\bc", True, True, True), ("?", "é", True, True, True), ("a.c", "abc", True, True, False), ("[]x]", "]", False, False, True), ("*[0-9]", "a\n7", False, False, True), ("[", "[", True, True, True)]
    for glob, path, pathname, period, want in cases:
        rule = match.glob_to_regex(glob, pathname, period)
        assert bool(re.search(rule.replace("\\z", "\\Z"), path)) == want, (glob, path)
        assert spark.range(1).select(F.lit(path).rlike(rule)).first()[0] == want, (glob, path)


def test_scalars(spark):
    names = {"x_2021-01-03_10-00-01-123_abcdef01.snap": 1609668001, "2021-02-29_10-00-01_abc.snap": 0, "2020-02-29_23-59-60_a.snap": 1583020800, "nothing.snap": 0, "a_b.snap": 0}
    df = spark.createDataFrame([(k,) for k in names], "n string")
    assert {r.n: r.t for r in df.select("n", scalars.parse_snapshot_timestamp(F.col("n")).alias("t")).collect()} == names
    one = spark.range(1)
    sizes = [one.select(scalars.format_bytes(F.lit(x).cast("long"))).first()[0] for x in (0, 1023, 1536, 1 << 20, 5 << 40)]
    assert sizes == ["0 B", "1023 B", "1.50 KB", "1.00 MB", "5.00 TB"]
    safe = {p: one.select(scalars.is_safe_relative_path(F.lit(p))).first()[0] for p in ("a/..x", "../a", "/a", "", "a/../b")}
    assert safe == {"a/..x": True, "../a": False, "/a": False, "": False, "a/../b": False}
    uri = one.select(scalars.parse_uri(F.lit("ssh://me@host:22/repo/")).alias("u")).first().u
    assert (uri.scheme, uri.user, uri.host, uri.port, uri.path) == ("ssh", "me", "host", 22, "/repo")
    assert one.select(scalars.parse_uri(F.lit("ssh://host:70000/x"))).first()[0] is None
    assert [one.select(scalars.parse_size(F.lit(x))).first()[0] for x in ("8K", "4M", "1K", "x")] == [8192, 4 << 20, None, None]


def test_sizes_are_rounded_as_sql_prints_them(spark):
    sizes = [1152, 1408, 4736, 17 << 17, (1 << 20) - 1, 9 << 37, 144088387479928832, 10_005 << 20, -5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in sizes], "n long").select(scalars.format_bytes(F.col("n"))).collect()]
    assert got == ["1.12 KB", "1.38 KB", "4.62 KB", "2.12 MB", "1024.00 KB", "1.12 TB", "131047.62 TB", "9.77 GB", "-5 B"]


def test_digests(spark):
    assert f"{int(hashing.fnv1a_64_of([b'a'])[0]):x}" == "af63dc4c8601ec8c"
    assert hashing.crc32c_of([b"123456789", b""]).tolist() == [0xE3069283, 0]
    df = spark.createDataFrame([(bytearray(b"123456789"),), (None,)], "x binary")
    assert [r[0] for r in df.select(hashing.crc32c("x")).collect()] == [0xE3069283, None]


def test_checksums_of_long_values_run_over_pieces():
    def plain(value):
        h = 0xFFFFFFFF
        for b in value:
            h ^= b
            for _ in range(8):
                h = h >> 1 ^ (0x82F63B78 if h & 1 else 0)
        return h ^ 0xFFFFFFFF

    rng, piece = random.Random(3), hashing.CRC32C_PIECE
    values = [rng.randbytes(n) for n in (0, 1, piece - 1, piece, piece + 1, 2 * piece, 3 * piece + 5, 0, 40_001, 8 * piece)]
    assert hashing.crc32c_of(values).tolist() == [plain(x) for x in values]
    began = time.process_time()
    hashing.crc32c_of([bytes(4 << 20)])
    assert time.process_time() - began < 5  # a step for each byte took more than 15 s


def test_packs_are_opened_by_their_own_entries(spark):
    rows = spark.createDataFrame([(f"{i:02d}", bytearray(f"text {i} ".encode() * (i + 1))) for i in range(40)], "chunk_id string, payload binary")
    made = packs.packed(packs.encoded(rows), 1, writers=3, limit=200)
    own = packs.unpacked(made)
    assert "Join" not in own._jdf.queryExecution().toString()
    want = {r.chunk_id: bytes(r.payload) for r in rows.collect()}
    assert {r.chunk_id: bytes(r.payload) for r in own.collect()} == want
    assert {r.chunk_id: bytes(r.payload) for r in packs.unpacked(made, made.select("pack_id", F.inline("entries"))).collect()} == want
    shut = packs.packed(packs.sealed(packs.encoded(rows), b"k" * 16), 1, writers=3, limit=200)
    assert all(r.payload is None for r in packs.unpacked(shut).collect())
    assert {r.chunk_id: bytes(r.payload) for r in packs.unpacked(shut, key=b"k" * 16).collect()} == want


def _scalar_cuts(data, sizes):
    strict, loose = sizes.masks()
    out, start = [], 0
    while start < len(data):
        n = len(data) - start
        cut, fp = min(n, sizes.most), 0
        if n > sizes.least:
            for i in range(cut):
                fp = ((fp << 1) + int(chunking.GEAR[data[start + i]])) % (1 << 64)
                if i >= sizes.least and fp & (strict if i < sizes.average else loose) == 0:
                    cut = i + 1
                    break
        out.append(start + cut)
        start += cut
    return out


def test_chunking_follows_the_scalar_rule():
    rng = random.Random(2)
    for least, average, most in ((64, 256, 1024), (4, 64, 300), (16, 32, 33)):
        sizes = chunking.ChunkSizes(least, average, most)
        for n in (0, 1, least, least + 1, 5000):
            data = bytes(rng.choice(b"abcdefgh \n\0\xff") for _ in range(n))
            assert chunking.cut_points(data, sizes) == _scalar_cuts(data, sizes)
    assert not chunking.incompressible(b"a" * 5000) and chunking.incompressible(rng.randbytes(5000))


def test_chunks_round_trip_and_damage(spark):
    texts = [(1, "abc" * 900), (2, ""), (3, "é" * 700), (4, "abc" * 900)]
    rows = chunks.content_chunks(spark.createDataFrame(texts, "k long, t string"), "k", "t", chunking.ChunkSizes(64, 256, 1024)).cache()
    stored = rows.dropDuplicates(["chunk_id"]).select("chunk_id", "payload")
    back = {r.k: (bytes(r.data).decode(), r.missing) for r in chunks.reconstruct(rows.select("k", "ord", "chunk_id"), stored, "k").collect()}
    assert back == {k: (t, 0) for k, t in texts if t}
    assert integrity.damaged_chunks(stored).isEmpty()
    assert integrity.damaged_chunks(stored.withColumn("payload", F.concat("payload", F.lit(b"x")))).count() == stored.count()


def test_integrity_and_prune(spark):
    refs = spark.createDataFrame([("s1", "a"), ("s1", "a"), ("s1", "z"), ("s2", "b")], "snapshot string, chunk_id string")
    index = spark.createDataFrame([("a", 1, 1, 75), ("b", 1, 1, 25), ("c", 2, 2, 10), ("d", 3, 9, 5), ("e", 4, 1, 1)], "chunk_id string, segment_id long, pack_id long, comp_size long")
    packs = spark.createDataFrame([(1, 101), (2, 10), (3, 7)], "pack_id long, bytes long")
    assert integrity.missing_refs(refs, index, "chunk_id").count() == 1
    assert [r.segment_id for r in integrity.orphan_segments(index, packs.where("pack_id < 3")).collect()] == [3]
    live = prune.live_chunks(refs, spark.createDataFrame([("s1",)], "snapshot string"))
    got = {r.pack_id: r.action for r in prune.classify_packs(index, live, packs).collect()}
    assert got == {1: "rewrite", 2: "delete", 3: "keep"}  # a pack without entries stays
    held = spark.createDataFrame([(3, "q"), (2, "c")], "pack_id long, chunk_id string")
    assert [r.pack_id for r in integrity.indexless_packs(held, packs, index).collect()] == [3]


def test_listing(spark):
    df = spark.createDataFrame([("a/b/c", 2), ("a/b", 1), ("a/.h", 2), ("ab/x", 2)], "path string, type int")
    assert {(r.name, r.is_dir) for r in listing.children(df, "/a/").collect()} == {("b", True), (".h", False)}
    assert [r.name for r in listing.panel(df).collect()] == ["a", "ab"]


FILES = "path string, type int, flags int, mode int, uid long, gid long, size long, mtime_ns long, ctime_ns long, dev long, ino long, symlink_target string, hardlink_to string, content binary"


def _file(path, data, ino=0, kind=2, target=None, mtime=1):
    return (path, kind, 0, 0o644, 0, 0, len(data or b""), mtime, mtime, 1, ino, target, None, data)


@pytest.mark.parametrize("key,algo", [(None, 0), (b"0123456789abcdef", 3)])
def test_catalog_round_trip(spark, tmp_path, key, algo):
    """Create, two snapshots, verify, restore, damage, repair, prune: bytes come back, and what is unsafe stops."""
    rng = random.Random(8)
    at = catalog.Catalog(spark, f"file://{tmp_path}/repo", key)
    at.create(uuid="u", chunk_min=64, chunk_avg=256, chunk_max=1024, compression=2, zstd_level=3, hash_algo=algo)
    at.create(uuid="other")
    assert at.config()["uuid"] == "u"
    texts = {"r/a": rng.randbytes(6000), "r/b": rng.randbytes(5000), "r/rep": b"abc" * 3000, "r/empty": b""}
    texts["r/link"] = texts["r/a"]
    first = [_file("r", None, kind=1), *(_file(p, d, ino=7 if p in ("r/a", "r/link") else 0) for p, d in texts.items()), _file("r/sym", None, kind=3, target="a")]
    at.backup(spark.createDataFrame(first, FILES), "s1", 1_600_000_000_000_000_000, writers=2, pack_bytes=2000)
    more = [_file("r/b", texts["r/b"]), _file("r/c", rng.randbytes(4000))]
    at.backup(spark.createDataFrame(more, FILES), "s2", 1_700_000_000_000_000_000, writers=2, pack_bytes=2000)
    for fast in (False, True):
        assert {r.n for r in at.verify(fast).collect()} == {0}
    assert {r.n for r in at.health().collect()} == {0}
    back = {r.path: r for r in at.restore("s1").collect()}
    assert {p: bytes(back[p].data) for p in texts} == texts and back["r/sym"].symlink_target == "a" and back["r"].data is None
    assert [r.path for r in at.restore("s2", patterns=["r/c"]).collect()] == ["r/c"]
    assert at.resolve("x/s1") == "s1" and at.recovered_uuid() == "u"
    held = at.table("pack_entries").join(at.table("packs"), "pack_id").collect()
    assert all(0 <= r.offset <= r.bytes - r.comp_size for r in held) and len({r.pack_id for r in held}) > 2
    got = at.prune(writers=1, last=1).first()
    assert got.freed == got.bytes_before - got.bytes_after > 0 and [r.name for r in at.snapshots().collect()] == ["s2"]
    assert {r.n for r in at.verify().collect()} == {0}
    assert {r.path: bytes(r.data) for r in at.restore("s2").collect()} == {p: bytes(d) for p, *_, d in more}
    at.replace("packs", at.table("packs").withColumn("payload", F.when(F.col("pack_id") == at.table("packs").agg(F.max("pack_id")).first()[0], F.lit(b"x")).otherwise(F.col("payload"))))
    assert next(r.n for r in at.verify().collect() if r.category == "damaged_packs") == 1 and next(r.n for r in at.verify().collect() if r.category == "damaged_chunks") > 0
    after = {r.category: r.n for r in at.repair().collect()}
    assert after["damaged_packs"] == 0 and after["missing_chunks"] > 0
    at.append("entries", at.entries("s2").limit(1).withColumns({"path": F.lit("../evil"), "snapshot": F.lit("s3")}))
    with pytest.raises(ValueError, match="unsafe"):
        at.restore("s3")
    at.register_views("t_")
    assert spark.sql("select count(*) from t_snapshots").first()[0] == 1


def test_rotation_and_blooms(spark):
    assert [(lambda r: [r.add(x) for x in (90, 90, 30, 30, 350, 10)])(packs.Rotation(100))] == [[0, 1, 2, 2, 3, 4]]
    ids = spark.createDataFrame([(s, hashlib.md5(b"%d %d" % (s, i)).hexdigest()) for s in (1, 2) for i in range(50)], "segment_id long, chunk_id string")
    found = packs.may_hold(packs.bloom(ids, bits=1 << 12), ids)
    assert found.join(ids, ["segment_id", "chunk_id"], "left_semi").count() == 100 and found.count() < 120


def test_hard_links_need_files_with_inodes(spark):
    rows = [("b", 2, 1, 5), ("a", 2, 1, 5), ("d", 1, 1, 5), ("e", 2, 1, 0), ("f", 2, 1, 0), ("g", 2, 2, 5), ("h", 2, 1, None)]
    got = {r.path: (r.canonical, r.is_link) for r in chunks.group_hardlinks(spark.createDataFrame(rows, "path string, type int, dev long, ino long")).collect()}
    assert got == {"a": ("a", False), "b": ("a", True)} | {p: (None, False) for p in "defgh"}


def test_null_and_empty_chunks_are_alike(spark):
    old, new = (spark.createDataFrame([("x", 2, 1, 0, 0, 0, 9, None, None, c)], ENTRY) for c in (None, []))
    assert [r.status for r in diff.snapshot_diff(old, new).collect()] == ["="]
