"""The registered query of each operator, with production parameters over whole tables, and its SQL where there is some."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairnlake.llm.quality import score_quality

    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairnlake.llm.jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), width=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairnlake.llm.toxicity import score_toxicity

    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairnlake.llm.hmm import score_hmm

    return score_hmm(_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairnlake.llm.pii import KINDS, RULES, find_pii, written

    found = find_pii(_table(spark, sf_dir, "documents"))
    join = lambda *parts: F.array_join(F.filter(F.array(*parts), lambda x: x != ""), ",")
    base = join(*map(written, RULES))
    terms = F.array_join(F.transform(F.array_sort("terms"), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in RULES]
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), join(*map(written, KINDS), terms).alias("spans"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairnlake.llm.dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairnlake.llm.ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairnlake.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairnlake.llm.mixing import mix_sources

    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", (F.round("position", 6) + 0.0).alias("position"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairnlake.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality, op2_jaccard, op3_toxicity, op4_hmm, op5_pii, op6_exact_dedup, op7_ann, op8_token_counts, op9_mixing, op10_packing, pipeline)}


#: DuckDB. Java's and RE2's classes are alike here; \x20 and \x09-\x0D are written as they are.
_DEDUP = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as n from documents)
select doc_id, min(doc_id) over (partition by n) as keep_id, count(*) over (partition by n) as group_size,
       doc_id = min(doc_id) over (partition by n) as kept, sha256(n) as text_sha256
from t
"""

_MIXING = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5(doc_id::varchar) as rank from documents
), s as (
  select source, sum(size)::bigint as source_size,
         [3, 1, 2][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int] as weight,
         [-0.5::double, 0.0::double, 0.5::double][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int] as slope
  from d group by source
), r as (
  select *, source_size * 2.0::double as cap, source_size * 2.0::double / weight as ratio from s
), l as (
  select *, (sum(source_size) over () * 1.5::double
             - coalesce(sum(cap) over (order by ratio, source is null, source rows between unbounded preceding and 1 preceding), 0.0))
            / sum(weight) over (order by ratio, source is null, source rows between current row and unbounded following) as level from r
), g as (
  select *, least(cap, weight * (max(level) over ())) as target from l
), o as (
  select d.doc_id, d.size, g.source_size, g.target, g.slope, round(g.target)::bigint as whole,
         (sum(d.size) over (partition by d.source order by d.rank, d.doc_id, d.size rows between unbounded preceding and current row) - d.size)::bigint as start
  from d join g on d.source is not distinct from g.source
), k as (
  select *, greatest(least(whole - start, size), 0) as once, greatest(least(whole - start - source_size, size), 0) as twice from o
)
select doc_id, size, source_size, target, (once + twice)::bigint as taken,
       round(case when once > 0 and target > 0 then
         case when slope = 0 then start / target
              else (sqrt(greatest((1 - slope) * (1 - slope) + 4 * slope * (start / target), 0.0)) - (1 - slope)) / (2 * slope) + 0.0 end end, 6) + 0.0 as position
from k
"""

_JACCARD = r"""
with recursive t as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select doc_id, list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as shingles from t
), d as (
  select doc_id, len(shingles)::bigint as n_shingles, shingles from s
), i as (
  select doc_id, n_shingles, unnest(shingles) as shingle from d
), l as (
  select a.doc_id as a, b.doc_id as b from i a join i b on a.shingle = b.shingle and a.doc_id <> b.doc_id
    and 100 * least(a.n_shingles, b.n_shingles) >= 90 * greatest(a.n_shingles, b.n_shingles)
  group by a.doc_id, b.doc_id, a.n_shingles, b.n_shingles
  having 100 * count(*) >= 90 * (a.n_shingles + b.n_shingles - count(*))
), r as (
  select doc_id, doc_id as met from d union select r.doc_id, l.b from r join l on l.a = r.met
)
select d.doc_id, d.n_shingles, min(r.met) as component_id from d join r on r.doc_id = d.doc_id group by d.doc_id, d.n_shingles
"""

ORACLE_SQL = {"op2_jaccard": _JACCARD, "op6_exact_dedup": _DEDUP, "op9_mixing": _MIXING}
