"""Information-theoretic sanitisation, in DataFrame functions only.

Entities are found by rules: mail addresses, IP addresses, card and phone numbers, and secrets (unbroken runs of letters
and digits that hold many bits, as keys and hashed passwords do). Over the whole corpus, documents are counted that hold an
entity, a term, and a term within a few words of an entity. A term discloses what it stands beside: one entity (the same
address again and again) or a kind of entities. It does so if it was seen there in several different contexts (exact
copies of a passage are one context), if most documents with the term have it there, and if the pointwise mutual
information passes a threshold. Every occurrence of such a term becomes a span of kind `term` (removed, where it nearly
determines what it discloses) or `broad` (generalised).

The patterns are possessive forms of the plain rules with the same matches: they neither recurse nor rescan long runs.

Defined cases: a null text is an empty one and has no spans. Offsets are code points. Kinds may overlap each other.
Rows that repeat, also rows with null ids, each get their spans and count as often as they are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.shared import cut, lower_ascii, small

#: The rules, in the order in which kinds are listed.
RULES = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kinds that the method adds: runs of at least 16 letters and digits, both being there.
ADDED = {"secret": r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{16,}+"}
KINDS = RULES | ADDED
#: The least bits of a secret: its length times the logarithm of the number of its different characters.
SECRET_BITS = 40
_PART = r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
#: A term is a whole run of these characters, wherever it stands; the search for disclosing terms has the same bounds.
_IN_TERM = r"[\p{L}\p{M}'-]"
_TERM = rf"(?<!{_IN_TERM})\p{{L}}{_IN_TERM}{{2,63}}+(?!{_IN_TERM})"
#: The code points on either side of an entity within which the nearest terms are looked for.
REACH = 512


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column, most: int = 19) -> Column:
    """Whether the check digit holds; leading zeros change nothing."""
    padded = F.lpad(digits, most, "0")
    doubled = F.translate(padded, "0123456789", "0246813579")
    total = F.lit(0)
    for i in range(most):
        total = total + F.substring(doubled if i % 2 else padded, most - i, 1).cast("int")
    return total % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    n = F.length(_digits(x))
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: x.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        "card": lambda: n.between(13, 19) & luhn(_digits(x)),
        "phone": lambda: n.between(9, 15),
        "secret": lambda: F.length(x) * F.log2(F.size(F.array_distinct(F.split(x, ""))).cast("double")) >= SECRET_BITS,
    }[kind]()


def _checker(kind: str):
    return lambda s: _valid(kind, s["value"])


def _tagger(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(kind).alias("kind"))


def located(text: Column, pattern: Column) -> Column:
    """array<struct<start, end, value>> of all leftmost non-overlapping matches: the text between the matches and the
    matches themselves add up to the offsets."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("value"))
    kind = "array<struct<start:int,end:int,value:string>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(steps, zero, step, lambda acc: acc["out"])).otherwise(F.array().cast(kind))


def entity_spans(docs: DataFrame) -> DataFrame:
    """(key, text) -> also an array column of valid spans for each kind."""
    hints = {
        "email": F.contains("text", F.lit("@")),
        "ip": F.col("text").rlike("[0-9][.][0-9]"),
        "card": F.col("text").rlike("[0-9][ 0-9-]{11}"),
        "phone": F.col("text").rlike("[+][0-9]"),
        "secret": F.col("text").rlike("[A-Za-z0-9]{16}"),
    }
    out = docs
    for kind, rule in KINDS.items():
        out = out.withColumn(kind, F.filter(located(F.when(hints[kind], F.col("text")).otherwise(""), F.lit(rule)), _checker(kind)))
    return out


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(_TERM), F.lit(0))


def beside_terms(spans: DataFrame, near: int) -> DataFrame:
    """(key, text, spans by kind) -> (key, kind, entity, context, term): the `near` nearest whole terms on either side of
    each entity, within REACH code points."""
    every = F.concat(*(F.transform(k, _tagger(k)) for k in KINDS))
    seen = spans.select("key", "text", F.explode(every).alias("s")).select("key", "s.*", F.substring("text", F.greatest(F.col("s.start") - REACH, F.lit(0)) + 1, F.least(F.col("s.start"), F.lit(REACH))).alias("before"), F.substring("text", F.col("s.end") + 1, F.lit(REACH)).alias("after"), F.length("text").alias("size"))
    # A run that the slice or the entity itself cuts is no whole term.
    drop = lambda when, text, rule: F.when(when, F.regexp_replace(text, rule, "")).otherwise(text)
    left = drop(F.col("start") > REACH, F.col("before"), rf"^{_IN_TERM}++")
    left = drop(F.col("value").rlike(rf"^{_IN_TERM}"), left, rf"{_IN_TERM}++$")
    right = drop(F.col("size") > F.col("end") + REACH, F.col("after"), rf"{_IN_TERM}++$")
    right = drop(F.col("value").rlike(rf"{_IN_TERM}$"), right, rf"^{_IN_TERM}++")
    terms = F.array_distinct(F.concat(F.reverse(F.slice(F.reverse(_terms(left)), 1, near)), F.slice(_terms(right), 1, near)))
    seen = seen.select("key", "kind", F.xxhash64("kind", F.lower("value")).alias("entity"), terms.alias("terms"))
    return seen.select("key", "kind", "entity", F.xxhash64("terms").alias("context"), F.explode("terms").alias("term"))


def disclosing_terms(base: DataFrame, spans: DataFrame, *, near: int = 4, support: int = 2, kind_support: int = 5, share: float = 0.5, bits: float = 3.0, certain: float = 0.9, broadcast_rows: int = 500_000) -> DataFrame:
    """(term, kind): the terms whose occurrence discloses an entity (met in `support` contexts at least) or a kind of
    entities (in `kind_support`). base: key, text; spans: key, text and the spans of documents that have some.

    The documents of every term are counted before that count meets a pair, so the join has a row for each pair."""
    copies = spans.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1")
    beside = cut(beside_terms(spans, near).distinct(), "beside")
    targets = F.array(F.struct(F.col("entity").alias("target"), F.lit(support).alias("least")), F.struct(F.xxhash64(F.lit("kind"), "kind").alias("target"), F.lit(kind_support).alias("least")))
    aimed = beside.select("key", "context", "term", F.explode(targets).alias("t")).select("key", "context", "term", "t.*")
    rows = F.coalesce("copies", F.lit(1))
    weighed = lambda df: df.join(small(copies, broadcast_rows), "key", "left").withColumn("docs", rows)
    contexts = aimed.select("term", "target", "least", "context").distinct().groupBy("term", "target", "least").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= F.col("least"))
    together = weighed(aimed.select("term", "target", "key").distinct()).groupBy("term", "target").agg(F.sum("docs").alias("together"))
    pairs = cut(contexts.join(together, ["term", "target"]).select("term", "target", "together"), "pairs")
    held = base.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("with_term"))
    with_target = weighed(aimed.select("target", "key").distinct()).groupBy("target").agg(F.sum("docs").alias("with_target"))
    corpus = base.agg(F.count("*").alias("corpus"))
    rated = held.join(small(pairs, broadcast_rows), "term").join(with_target, "target").crossJoin(F.broadcast(corpus))  # one row
    of_term = F.col("together") / F.col("with_term")
    rated = rated.where((of_term >= share) & (F.log2(of_term * F.col("corpus") / F.col("with_target")) >= bits))
    return rated.groupBy("term").agg(F.when(F.max(of_term) >= certain, "term").otherwise("broad").alias("kind"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, text): rows with a key in common are alike; inside a struct, null equals null."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return base.select(F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("key"), "text")


def _all_spans(base: DataFrame, broadcast_rows: int, **thresholds) -> DataFrame:
    """(key, an array of spans for each kind, terms), one row for each row of base."""
    some = F.greatest(*(F.size(k) for k in KINDS)) > 0
    spans = cut(entity_spans(base).select("key", *KINDS, F.when(some, F.col("text")).alias("text")), "spans")
    terms = cut(disclosing_terms(base, spans.where("text is not null"), broadcast_rows=broadcast_rows, **thresholds), "terms")
    known = small(terms, broadcast_rows)
    # Documents with such terms, and the terms that each one has.
    words = base.select("key", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).join(known, "term").groupBy("key").agg(F.collect_set(F.struct("term", "kind")).alias("kinds"))
    words = small(cut(words.withColumn("terms", F.transform("kinds", lambda s: s["term"])), "documents"), broadcast_rows)
    longest = F.array_sort("terms", lambda a, b: F.length(b) - F.length(a))
    rule = F.concat(F.lit(rf"(?<!{_IN_TERM})(?:"), F.array_join(longest, "|"), F.lit(rf")(?!{_IN_TERM})"))
    at = base.join(words, "key").withColumn("found", located(lower_ascii(F.col("text")), rule))
    of = F.map_from_entries("kinds")
    at = at.select("key", F.transform("found", lambda s: F.struct(of[s["value"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))).alias("terms"))
    at = at.groupBy("key").agg(F.first("terms").alias("terms"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    return spans.join(small(cut(at, "term-spans"), broadcast_rows), "key", "left").select("key", *KINDS, F.coalesce("terms", none).alias("terms"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, broadcast_rows: int = 500_000, **thresholds) -> DataFrame:
    """doc_id, an array of spans for each kind of entity, and `terms`: array<struct<kind, start, end, value>>."""
    return _all_spans(_rows(docs, id_col, text_col), broadcast_rows, **thresholds).select("key.doc_id", *KINDS, "terms")


def written(kind: str) -> Column:
    """kind:start:end of the spans of a kind, comma-joined."""
    return F.array_join(F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"])), ",")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, broadcast_rows: int = 500_000, **thresholds) -> DataFrame:
    """doc_id and the sanitised text of each row: entities become their kind in brackets, disclosing terms [TERM] or nothing."""
    base = _rows(docs, id_col, text_col)
    found = _all_spans(base, broadcast_rows, **thresholds).dropDuplicates(["key"])
    mark = lambda k: F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{k.upper()}]").alias("by")))
    terms = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["kind"] == "term", "").otherwise("[TERM]").alias("by")))
    every = F.array_sort(F.concat(*map(mark, KINDS), terms))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        put = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring("text", acc["at"] + 1, s["start"] - acc["at"]), s["by"]).alias("out"))
        return F.when(s["start"] >= acc["at"], put).otherwise(acc)

    joined = base.join(found, "key").select("key.doc_id", "text", F.aggregate(every, zero, step).alias("done"))
    return joined.select("doc_id", F.concat("done.out", F.substring("text", F.col("done.at") + 1, F.length("text"))).alias("text"))
