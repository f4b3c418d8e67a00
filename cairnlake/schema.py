"""Tables of a catalog. Times are nanoseconds since the epoch; ids of chunks are hexadecimal strings."""

from __future__ import annotations

DIRECTORY, FILE, SYMLINK, HARDLINK, OTHER = 1, 2, 3, 4, 5
HARDLINK_FLAG, DELTA_FLAG = 0x2, 0x4
COMPRESSED_FLAG, ENCRYPTED_FLAG, ZSTD_FLAG = 0x1, 0x2, 0x4

TABLES = {
    "repo_config": "uuid string, created_ns long, chunk_min long, chunk_avg long, chunk_max long, hash_algo int, compression int, flags int, encrypted boolean, zstd_level int, cipher int",
    "snapshots": "name string, snapshot_id string, repo_uuid string, created_ns long, hostname string, root_path string",
    "entries": "snapshot string, path string, type int, flags int, mode int, uid long, gid long, size long, mtime_ns long, ctime_ns long, dev long, ino long, symlink_target string, hardlink_to string, chunks array<string>, delta_source_chunks array<string>",
    "chunk_index": "chunk_id string, segment_id long, pack_id long, offset long, comp_size long, uncomp_size long, flags int",
    "packs": "pack_id long, bytes long, stored_crc long, payload binary",
    "pack_entries": "pack_id long, chunk_id string, offset long, comp_size long, uncomp_size long, flags int",
    "bloom_segments": "segment_id long, size_bits long, num_hashes int, bits binary",
    "file_cache": "path string, dev long, ino long, size long, mtime_ns long, ctime_ns long, mode int, chunks array<string>",
}
