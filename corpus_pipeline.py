"""From raw documents to packed training sequences: quality, exact copies, near copies, mixing, packing.

Every stage decides by row, and further columns of any name go through as they are. Rows with a null id are documents like any other, and rows that share an id are documents
of their own: each is scored, compared and mixed by its own text, and packing takes what stays with the id it has. Which
of the rows that share an id the mix takes first follows from how they are stored.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm.dedup import NO_ID, exact_dedup
from cairnlake.llm.jaccard import jaccard_components
from cairnlake.llm.mixing import mix_sources
from cairnlake.llm.packing import pack
from cairnlake.llm.quality import score_quality
from cairnlake.llm.shared import cut, forget, small, watched

#: Most rows of ids or positions that are sent to every executor; they are counted first, and joins shuffle beyond that.
BROADCAST_ROWS = 2_000_000


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs with a column _row that is different in every row: the id itself where no other row has it, and another
    number where the id is null or repeats. Also (_row, doc_id) of all rows, or None if every row keeps its id."""
    id_ = F.col("doc_id").cast("long")
    again = cut(docs.groupBy(id_.alias("_id")).count().where("count > 1 or _id is null").select("_id"), "repeated")
    if again.isEmpty():
        return docs.withColumn("_row", id_), None
    odd = F.broadcast(again) if again.count() <= 1_000_000 else again
    met = docs.withColumn("_id", id_)
    plain = met.join(odd, "_id", "left_anti").where("_id is not null").select(*docs.columns, F.col("_id").alias("_row"))
    # Written once, so that a row has the same number each time it is read.
    rest = met.join(odd, met["_id"].eqNullSafe(odd["_id"]), "left_semi").select(*docs.columns, F.monotonically_increasing_id().alias("_at"))
    rest = cut(rest, "numbered")
    for seed in range(64):
        # With a fixed seed the hash of a long is one to one, so only the ids of other rows can be met.
        rows = rest.withColumn("_row", F.xxhash64(F.lit(seed), "_at")).drop("_at")
        if rows.select("_row").join(plain.select("_row"), "_row", "left_semi").isEmpty():
            whole = plain.unionByName(rows)
            return whole, whole.select("_row", id_.alias("doc_id"))
    raise RuntimeError("no free numbers for rows with null or repeated ids")


def _first(groups: DataFrame, ids: DataFrame | None) -> DataFrame:
    """groups (_row, _group) -> the _row that stays for each group: that with the smallest id, a null id being the last."""
    if ids is None:
        return groups.where("_row = _group").select("_row")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    return groups.join(ids, "_row").groupBy("_group").agg(F.min(order).alias("top")).select("top._row")


def _kept(docs: DataFrame, numbered: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows with those numbers, with the columns of docs."""
    return numbered.join(small(cut(rows.select("_row"), "kept"), BROADCAST_ROWS), "_row", "left_semi").select(*docs.columns)


def _apart(stage):
    """The stage with all columns but those it reads under names of their own meanwhile, so that none can clash."""

    @functools.wraps(stage)
    def whole(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        safe = [c if c in ("doc_id", "text", "source") else f"extra{k}" for k, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*safe), sf_dir).toDF(*docs.columns)

    return whole


@_apart
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, each row by its own text."""
    numbered, _ = _numbered(docs)
    scored = score_quality(numbered, spark.read.parquet(f"{sf_dir}/labels.parquet"), row_col="_row")
    return _kept(docs, numbered, scored.where("predicted = 1"))


@_apart
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each text."""
    numbered, ids = _numbered(docs)
    # exact_dedup writes the largest long as null: here it is a number like any other.
    keep = F.coalesce("keep_id", F.lit(NO_ID))
    groups = exact_dedup(numbered, id_col="_row").select(F.col("doc_id").alias("_row"), keep.alias("_group"))
    return _kept(docs, numbered, _first(groups, ids))


@_apart
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each group of near copies (five words, similarity of 0.8 or more)."""
    numbered, ids = _numbered(docs)
    groups = jaccard_components(numbered, id_col="_row").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    return _kept(docs, numbered, _first(groups, ids))


@_apart
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix in the order of the curriculum: one row for each time that a document is taken, and
    of the one document in a source that the target cuts, as many words as it takes."""
    numbered, _ = _numbered(docs)
    mixed = mix_sources(numbered, ordered=False, row_col="_row")
    words = F.col("taken") - F.when(F.col("again").isNotNull(), F.col("size")).otherwise(0)
    times = F.array(F.struct(F.col("position"), F.when(F.col("again").isNotNull(), F.col("size")).otherwise(F.col("taken")).alias("words")), F.struct(F.col("again").alias("position"), words.alias("words")))
    rows = mixed.select("_row", "size", F.explode(times).alias("t")).where("t.position is not null").select("_row", "size", "t.position", "t.words")
    rows = cut(rows.withColumnsRenamed({"words": "_words", "size": "_size", "position": "_position"}), "mix")
    out = numbered.join(small(rows, BROADCAST_ROWS), "_row")
    out = out.withColumn("text", F.expr("case when _words < _size then array_join(slice(regexp_extract_all(text, '[\\\\x20\\\\x09-\\\\x0D]*[^\\\\x20\\\\x09-\\\\x0D]+', 0), 1, cast(_words as int)), '') else text end"))
    return out.orderBy("_position", "doc_id", "_row").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    import public_tokenizers

    # Fewer words are kept than alone: the executor's heap is full after the stages before.
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), words=200_000)


STAGES = [("quality classifier", quality), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies), ("mixing sources to target weights", mixing), ("packing", packing)]

#: SQL cannot express a trained classifier or packing; the tests compare the stages with plainer versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. What a stage has written on the way goes as soon as its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with watched(spark) as kept:
            docs = cut(stage(spark, docs, sf_dir), f"stage{k}")
            kept.append(docs)
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
