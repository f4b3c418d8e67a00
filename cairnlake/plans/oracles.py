"""The SQL of each registered query, for DuckDB over the same tables."""

from __future__ import annotations


def _parts(until: str) -> str:
    return f"""select 'part/' || l_partkey as path, case when v.f = 'A' then 3 else 2 end as type, v.l as mode, v.q::bigint as size, v.d as mtime, v.s::varchar as target
    from (select l_partkey, max(struct_pack(d := l_shipdate, o := l_orderkey, l := l_linenumber, s := l_suppkey, q := l_quantity, f := l_returnflag)) as v
          from lineitem where l_shipdate < timestamp '{until}' group by l_partkey) where v.f <> 'R'"""


_DIFF = f"""select coalesce(a.path, b.path) as path,
    case when a.path is null then 'A' when b.path is null then 'D' when a.type <> b.type then 'T'
         when a.type = 2 and (a.size <> b.size or (a.size % 3 <> 0 and a.target <> b.target)) then 'M' when a.type = 3 and a.target <> b.target then 'M'
         when a.mode <> b.mode or a.mtime <> b.mtime then 'C' else '=' end as status
    from ({_parts("1997-01-01")}) a full join ({_parts("1998-06-01")}) b on a.path = b.path"""

_ENTRIES = "(select source as snapshot, source || '/' || lang || '/' || doc_id as path, case lang when 'en' then 2 when 'de' then 3 else 1 end as type, strlen(text)::bigint as size, text from documents)"
_INDEX = "(select o_orderkey as chunk_id, o_custkey as pack_id, floor(o_totalprice)::bigint as comp_size from orders where o_orderstatus <> 'P')"
_PACKS = f"(select c_custkey as pack_id, sum(comp_size)::bigint as bytes from customer join {_INDEX} on pack_id = c_custkey where c_acctbal >= 0 group by 1)"
_PAGES = "(select page_id, regexp_replace(url, '^[a-z]+://', '') as path from pages)"
_LIVE = "(select distinct l_orderkey as chunk_id from lineitem where l_returnflag = 'N')"
_COUNTERS = f"""select snapshot, count(*) as entry_count, count(*) filter (type = 2) as file_count, count(*) filter (type = 1) as dir_count,
    count(*) filter (type = 3) as symlink_count, sum(size)::bigint as logical_bytes, count(*) filter (text <> '') as chunk_refs from {_ENTRIES} group by snapshot"""


def _last(n: int) -> str:
    return f"(select name, ts from s order by ts desc, name desc limit {n})"


def _period(unit: str, n: int) -> str:
    return f"""(select name, ts from (select *, row_number() over (partition by date_trunc('{unit}', ts) order by ts desc, name desc) as k,
        dense_rank() over (order by date_trunc('{unit}', ts) desc) as p from s) where k = 1 and p <= {n})"""


def _kept(*parts: str) -> str:
    return "with s as (select o_orderkey as name, o_orderdate as ts from orders) " + " union ".join(parts)


_UNION = _kept(_last(5), _period("day", 7), _period("week", 4), _period("month", 12), _period("year", 3))
_MISSING = f"(select l_returnflag as snapshot from lineitem where l_orderkey not in (select chunk_id from {_INDEX}))"
_LOST = f"(select l_returnflag as snapshot from lineitem join {_INDEX} on chunk_id = l_orderkey where pack_id not in (select pack_id from {_PACKS}))"
_FLAGGED = f"(select i.*, v.chunk_id is not null as live from {_INDEX} i left join {_LIVE} v on v.chunk_id = i.chunk_id)"

_ALL_PACKS = "(select c_custkey as pack_id, coalesce((select sum(floor(o_totalprice)) from orders where o_custkey = c_custkey), 0)::bigint as bytes from customer where c_acctbal >= 0)"
_CLASSIFIED = f"""with o as (select o_custkey, floor(o_totalprice)::bigint as size, exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'N') as alive from orders),
    p as (select pack_id, any_value(bytes) as bytes, count(*) filter (alive) as live_chunks, count(*) filter (not alive) as dead_chunks, coalesce(sum(size) filter (not alive), 0)::bigint as dead_bytes
          from {_ALL_PACKS} left join o on o_custkey = pack_id group by pack_id)
    select pack_id, live_chunks, dead_chunks, dead_bytes, case when dead_chunks = 0 then 'keep' when live_chunks = 0 then 'delete' when 4 * dead_bytes >= bytes then 'rewrite' else 'keep' end as action from p"""

ORACLES = {
    "snapshot_diff": _DIFF,
    "snapshot_diff_summary": f"select status, count(*) as n from ({_DIFF}) group by status",
    "retention_last": _kept(_last(25)),
    "retention_daily": _kept(_period("day", 14)),
    "retention_weekly": _kept(_period("week", 20)),
    "retention_monthly": _kept(_period("month", 18)),
    "retention_yearly": _kept(_period("year", 4)),
    "retention_union": _UNION,
    "retention_dry_run": f"select (select count(*) from orders) as total, count(*) as keep, (select count(*) from orders) - count(*) as delete from ({_UNION})",
    "manifest_counters": _COUNTERS,
    "repo_info": f"""select *, round(chunk_refs::double / unique_chunks, 4) as dedup_ratio, round(logical_bytes::double / pack_bytes, 4) as overall_ratio from
        (select count(*) as snapshots, sum(entry_count)::bigint as entries, sum(logical_bytes)::bigint as logical_bytes, sum(chunk_refs)::bigint as chunk_refs from ({_COUNTERS})),
        (select count(*) as unique_chunks, sum(2 * comp_size)::bigint as uncomp_bytes, sum(comp_size)::bigint as comp_bytes,
                (select count(*) filter (left(o_orderpriority, 1) in ('1', '3', '5')) from orders where o_orderstatus <> 'P') as compressed,
                (select count(*) filter (left(o_orderpriority, 1) in ('2', '4')) from orders where o_orderstatus <> 'P') as uncompressed,
                round(sum(2 * comp_size)::double / sum(comp_size), 4) as compression_ratio from {_INDEX}),
        (select count(*) as packs, sum(bytes)::bigint as pack_bytes, (sum(bytes) // count(*))::bigint as average_bytes from {_PACKS})""",
    "create_stats": """select i as input_bytes, o as output_bytes, round(greatest(0.0::double, 100.0::double - 100.0::double * round(o::double / i, 4)), 2) as saved from
        (select sum(strlen(text))::bigint as i from documents), (select sum(n)::bigint as o from (select max(n_chars) as n from documents where text <> '' group by text))""",
    "pack_stats": f"select count(*) as packs, sum(bytes)::bigint as pack_bytes, (sum(bytes) // count(*))::bigint as average_bytes from {_PACKS}",
    "hardlink_groups": """select path, canonical, path <> canonical as is_link from
        (select source || '/' || doc_id as path, min(source || '/' || doc_id) over (partition by text, doc_id % 2) as canonical, count(*) over (partition by text, doc_id % 2) as n
         from documents where lang is distinct from 'de' and (n_chars % 7 <> 0 or n_chars is null) and text is not null) where n > 1""",
    "search_substring": f"select page_id, path from {_PAGES} where contains(path, 'e.com/d')",
    "search_glob": f"select page_id, path from {_PAGES} where regexp_matches(path, '^[^./][^/]*/[^./][^/]*/([^./][^/]*)?[0-9]$') or regexp_matches(path, '^[^./][^/]*//[0-9]$') or regexp_matches(path, '^/[^./]*/[0-9]$')",
    "search_totals": f"select count(*) filter (regexp_matches(path, '^[^./][^/]*/en/[^./][0-4][^/]*$')) as matches, count(distinct snapshot) as scanned from {_ENTRIES}",
    "ls_contains": f"select page_id, path from {_PAGES} where contains(lower(path), 'example')",
    "ls_children": f"select name, bool_or(d) as is_dir from (select split_part(substr(path, 6), '/', 1) as name, contains(substr(path, 6), '/') or type = 1 as d from {_ENTRIES} where starts_with(path, 'src0/')) group by name",
    "ls_prefix": f"select path, size from {_ENTRIES} where starts_with(path, 'src0/en/')",
    "tree_sizes": f"select split_part(path, '/', 1) as name, sum(size)::bigint as bytes, count(*) as files from {_ENTRIES} group by 1",
    "extract_match": f"select path from {_ENTRIES} where starts_with(path, 'src1/') or regexp_matches(path, '^src2/.*/1.*$')",
    "cache_hits": f"""select a.path from ({_parts("1998-06-01")}) a join ({_parts("1997-01-01")}) b on a.path = b.path and a.size = b.size and a.mtime = b.mtime and a.mode = b.mode
        where b.target in (select s_suppkey::varchar from supplier where s_acctbal >= 0)""",
    "stale_cache": f"select path from ({_parts('1998-06-01')}) where target not in (select s_suppkey::varchar from supplier where s_acctbal >= 0)",
    "missing_index_refs": f"select snapshot, count(*) as missing from {_MISSING} group by 1",
    "missing_pack_refs": f"select snapshot, count(*) as missing from {_LOST} group by 1",
    "orphan_segments": f"""with o as (select (o_orderdate::date - date '1970-01-01')::bigint as segment_id, o_custkey as pack_id from orders)
        select distinct segment_id from o where segment_id not in (select pack_id from {_PACKS}) and segment_id not in (select segment_id from o where pack_id in (select pack_id from {_PACKS}))""",
    "indexless_packs": "select p_partkey as pack_id from part where p_partkey not in (select l_partkey from lineitem join supplier on s_suppkey = l_suppkey where s_acctbal < 500)",
    "rebuilt_index": "select o_orderkey as chunk_id, o_custkey as pack_id, 99::bigint as segment_id from orders where o_orderstatus = 'P'",
    "latest_index": "select l_partkey as chunk_id, max(l_orderkey * 10 + l_linenumber) as segment_id, arg_max(l_suppkey, l_orderkey * 10 + l_linenumber) as pack_id from lineitem group by 1",
    "health_report": f"""with c as (select 'missing_chunks' as category, count(*) as n from {_MISSING} union all select 'missing_packs', count(*) from {_LOST})
        select * from c union all select 'total', sum(n)::bigint from c""",
    "live_set": f"select chunk_id from {_LIVE}",
    "dead_chunks": f"select chunk_id, pack_id from {_FLAGGED} where not live",
    "pack_classify": _CLASSIFIED,
    "prune_totals": f"""select count(*) as packs_before, sum(bytes)::bigint as bytes_before, count(*) filter (action <> 'delete') as packs_after,
        coalesce(sum(bytes) filter (action <> 'delete'), 0)::bigint as bytes_after, coalesce(sum(bytes) filter (action = 'delete'), 0)::bigint as freed from ({_CLASSIFIED}) join {_ALL_PACKS} using (pack_id)""",
    "pack_rotation": """with recursive d as (select source, doc_id, coalesce(n_chars, 0) as n, row_number() over (partition by source order by doc_id) as k from documents),
        r as (select source, k, doc_id, 0::bigint as pack, 36 + n as fill from d where k = 1
              union all select d.source, d.k, d.doc_id, r.pack + (r.fill >= 20000 or r.fill + d.n > 20000)::bigint, case when r.fill >= 20000 or r.fill + d.n > 20000 then 36 else r.fill end + d.n
              from r join d on d.source is not distinct from r.source and d.k = r.k + 1)
        select doc_id, pack from r""",
    "pack_round_trip": "select distinct md5(text) as chunk_id, text from documents where text is not null",
    "bloom_lookup": "select s_suppkey % 3 as segment_id, count(*) as n from supplier group by 1",
    "scalar_functions": r"""with o as (select *, floor(o_totalprice * o_custkey)::bigint as b, regexp_replace(o_orderpriority, '[^A-Za-z0-9_-]', '_', 'g') || '_' || strftime(o_orderdate, '%Y-%m-%d_%H-%M-%S-%g') || '_' || left(md5(o_orderkey::varchar), 8) || '.snap' as name from orders)
        select o_orderkey, case when b >= 1024::bigint ** 4 then printf('%.2f TB', b / 1024.0::double ** 4) when b >= 1024 ** 3 then printf('%.2f GB', b / 1024.0::double ** 3) when b >= 1024 ** 2 then printf('%.2f MB', b / 1024.0::double ** 2)
                                when b >= 1024 then printf('%.2f KB', b / 1024.0::double) else b || ' B' end as size_text,
               strftime(o_orderdate, '%Y-%m-%d %H:%M:%S UTC') as time_text, name, floor(epoch(o_orderdate))::bigint as parsed, o_orderkey % 4 = 3 as safe, lower(hex(o_orderstatus)) as status_hex from o""",
    "fnv1a64": """select source, lower(printf('%016x', h)) as digest from (select source, list_reduce([14695981039346656037::hugeint] || list_transform(range(1, length(source) + 1), lambda i: ascii(source[i])::hugeint),
        lambda h, b: (xor(h, b) * 1099511628211::hugeint) % 18446744073709551616::hugeint)::ubigint as h from (select distinct source from documents))""",
    "fixed_block_dedup": """with p as (select unnest(list_transform(range(0, greatest(1, ceil(length(text) / 256.0)::bigint)), lambda i: substring(text, i * 256 + 1, 256))) as x from documents)
        select count(*) as refs, count(distinct x) as unique_chunks, round(count(*)::double / count(distinct x), 4) as ratio from p""",
    "reconstruct": "select doc_id, text, 0::bigint as missing from documents",
}
