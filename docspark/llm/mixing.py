"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions alone.

Every source has a target in words. The ratio of target to source size is split into whole copies, which every document gets for certain, and a
rest of words, which one more copy of some documents must bring. Documents of a source fall into classes of nearly equal size (eight to
an octave). From the largest class down, each gives a fixed number n of documents: as many as its share of the rest and what larger classes left
over come to; a second turn settles what is over at the end. Inside a class the inclusion probability of a document is proportional to its size, p = n * size / size of the class; documents
are ranked by the Pareto variable ``(u / (1 - u)) / (p / (1 - p))``, u being a keyed hash of the document, and the n lowest are taken. So
the sample has a fixed size, probabilities are unequal, and as classes are narrow the words come near the target.

The n-th lowest rank is found without sorting a class in one task: counts per slice of the rank give the slice that holds it, that slice is
sliced again, and only the documents of the last one (about one in 16 million) are ordered in a window. Of rows that are equal in all that
ranks them some may be taken and others not; they are numbered by the part of the input that they are in, never in one task.

Defined cases: a null text has size 0; null is a source of its own, the last; documents of size 0 take 0; rows that repeat a doc_id are
ranked one by one (ties by size, then text hash); rows without a doc_id are told apart by their text; an empty table gives an empty result; other
columns are carried by ``mix`` and ignored by ``mix_report``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import BROADCAST_ROWS, WORD, materialize, small_join

#: Weights by the order of sources, repeated; a source gives at most MOST times its size.
WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"
#: Bits of u; of a slice of the rank.
BITS, SLICE = 52, 12
#: Classes to an octave of sizes.
CLASSES = 8
#: Inclusion probabilities are kept below 1, as their odds must be finite.
CERTAIN = 1 - 2.0**-40


def numbered(rows: DataFrame, order: Column, name: str) -> DataFrame:
    """rows with ``name``, their place from 0 in the order: places inside ranges, and how many rows the ranges before hold."""
    parts = materialize(rows.repartitionByRange(order).withColumn("__part", F.spark_partition_id()), "mix-ranges")
    counts = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row a range, however many rows
    counts = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    return small_join(parts.withColumn("__place", place), counts, ["__part"]).withColumn(name, F.col("__before") + F.col("__place")).drop("__part", "__before", "__place")


def sources_with_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target: 100 % of all words shared by weight, capped at ``most`` times a source's size, excess reshared.

    Sources above their cap give it, and the rest shares what is left by weight, again until none is above: a sum over all sources a round.
    """
    rows = numbered(sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), F.col("source").asc_nulls_last(), "k")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("k", F.lit(len(weights))) + 1).cast("int")).cast("long")
    rows = materialize(rows.select("source", "source_size", weight.alias("w"), (F.lit(most) * F.col("source_size")).cast("long").alias("cap")), "mix-sources")
    capped, level, known = F.lit(False), None, -1
    while True:
        free = F.when(capped, 0)
        left, of, n = rows.agg(F.sum("source_size") - F.sum(F.when(capped, F.col("cap")).otherwise(0)), F.sum(free.otherwise(F.col("w"))), F.count_if(capped)).first()
        if not of or n == known:
            break
        known, level = n, float(left) / float(of)
        capped = F.lit(level) * F.col("w") > F.col("cap")
    target = F.col("cap").cast("double") if level is None else F.least(F.lit(level) * F.col("w"), F.col("cap").cast("double"))
    return rows.select("source", "source_size", target.alias("target"))


def _class(size: Column) -> Column:
    """Class of a size from 1 on: its octave, and the eighth of it."""
    octave = F.length(F.bin(size)) - 1
    return octave * CLASSES + (F.floor(size * CLASSES / F.pow(F.lit(2.0), octave)) - CLASSES).cast("int")


def _takes(classes: DataFrame) -> DataFrame:
    """s, c, n: how many documents of each class (s, c, docs, words, rest) get one more copy.

    What a class leaves over goes to the next smaller one; what is over at the end is given or taken back in a second turn.
    """
    row = F.struct((-F.col("c")).alias("down"), "docs", (F.col("words") / F.col("docs")).alias("mean"), "rest", F.lit(0).cast("long").alias("n"))
    listed = classes.groupBy("s").agg(F.sort_array(F.collect_list(row)).alias("all"))  # at most CLASSES rows an octave

    def step(done, x):
        due = done["over"] + x["rest"]
        more = F.least(x["docs"] - x["n"], F.greatest(-x["n"], F.floor(due / x["mean"] + 0.5).cast("long")))
        left = F.struct(x["down"].alias("down"), x["docs"].alias("docs"), x["mean"].alias("mean"), F.lit(0.0).alias("rest"), (x["n"] + more).alias("n"))
        return F.struct((due - more * x["mean"]).alias("over"), F.concat(done["out"], F.array(left)).alias("out"))

    empty = F.array().cast("array<struct<down:int,docs:bigint,mean:double,rest:double,n:bigint>>")
    first = listed.select("s", F.aggregate("all", F.struct(F.lit(0.0).alias("over"), empty.alias("out")), step).alias("x"))
    second = first.select("s", F.aggregate("x.out", F.struct(F.col("x.over").alias("over"), empty.alias("out")), step)["out"].alias("x"))
    return second.select("s", F.explode("x").alias("x")).select("s", (-F.col("x.down")).alias("c"), "x.n")


def _place() -> Column:
    """What orders documents of a class; a null doc_id comes first."""
    return F.struct("rank", F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), "size", "tie")


def _source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _decided(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """sizes (doc_id, source, size, h, tie, ...) plus source_size, target, copies, and some: of rows equal to this one, that many take one more (or null)."""
    plan = materialize(sources_with_targets(sizes, weights, most), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))).otherwise(F.lit(0.0))
    plan = plan.select(_source_key("source").alias("s"), "source_size", "target", F.floor(ratio).alias("whole"))
    plan = plan.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    rows = sizes.withColumn("s", _source_key("source")).withColumn("c", F.when(F.col("size") > 0, _class(F.col("size"))).otherwise(-1))

    classes = rows.where("size > 0").groupBy("s", "c").agg(F.count("*").alias("docs"), F.sum("size").alias("words"))
    classes = small_join(classes, plan.where("source_size > 0"), ["s"]).select("s", "c", "docs", "words", (F.col("rest") * F.col("words") / F.col("source_size")).alias("rest"))
    classes = materialize(classes, "mix-classes")
    taken = materialize(classes.join(_takes(classes), ["s", "c"]).select("s", "c", "docs", "words", "n"), "mix-takes")
    cut = taken.where("n > 0 AND n < docs").select("s", "c", "words", "n")

    u = (F.col("h") + F.lit(0.5)) * F.lit(2.0**-BITS)
    p = F.least(F.col("n") * F.col("size") / F.col("words"), F.lit(CERTAIN))
    ranked = small_join(rows, cut, ["s", "c"]).withColumn("rank", (u / (1 - u)) / (p / (1 - p))).withColumn("v", F.col("rank") / (1 + F.col("rank")))
    found, inside = cut.select("s", "c", "n").withColumn("before", F.lit(0).cast("long")), ranked
    for level in (1, 2):
        slice_ = F.floor(F.col("v") * F.lit(float(1 << SLICE * level)))
        counts = inside.withColumn("b", slice_).groupBy("s", "c", "b").agg(F.count("*").alias("m"))
        upto = F.sum("m").over(Window.partitionBy("s", "c").orderBy("b"))
        counts = small_join(counts.withColumn("upto", upto), found.select("s", "c", "n", "before"), ["s", "c"]).where(F.col("before") + F.col("upto") >= F.col("n"))
        first = F.min_by(F.struct("b", "n", (F.col("before") + F.col("upto") - F.col("m")).alias("before")), F.col("b"))
        found = materialize(counts.groupBy("s", "c").agg(first.alias("x")).select("s", "c", "x.*"), "mix-cut")
        inside = small_join(ranked.withColumn("b", slice_), found.select("s", "c", "b"), ["s", "c", "b"], "left_semi").drop("b")
    # Rows of one place count together; at most one place of a class is taken in part.
    places = inside.groupBy("s", "c", _place().alias("at")).agg(F.count("*").alias("m"))
    places = places.withColumn("upto", F.sum("m").over(Window.partitionBy("s", "c").orderBy("at")))
    places = small_join(places, found.select("s", "c", "n", "before"), ["s", "c"]).withColumn("left", F.col("n") - F.col("before") - F.col("upto") + F.col("m"))
    edge = places.groupBy("s", "c").agg(
        F.max(F.when(F.col("left") >= F.col("m"), F.col("at"))).alias("last"), F.max(F.when((F.col("left") > 0) & (F.col("left") < F.col("m")), F.struct("at", "left"))).alias("split"),
    )
    cuts = taken.join(found.select("s", "c", "b"), ["s", "c"], "left").join(edge, ["s", "c"], "left")
    cuts = materialize(cuts.select("s", "c", "docs", "words", "n", "b", "last", "split"), "mix-edges")

    rows = small_join(small_join(rows, plan.select("s", "source_size", "target", "whole"), ["s"]), cuts, ["s", "c"], "left")
    between = F.col("b").isNotNull()
    p = F.least(F.col("n") * F.col("size") / F.when(between, F.col("words")), F.lit(CERTAIN))
    rows = rows.withColumn("rank", F.when(between, (u / (1 - u)) / (p / (1 - p))))
    rows = rows.withColumn("slice", F.floor(F.col("rank") / (1 + F.col("rank")) * F.lit(float(1 << 2 * SLICE))))
    more = F.when(~between, F.coalesce(F.col("n") > 0, F.lit(False))).when(F.col("slice") != F.col("b"), F.col("slice") < F.col("b")).otherwise(F.coalesce(_place() <= F.col("last"), F.lit(False)))
    some = F.when(between & (F.col("slice") == F.col("b")) & (_place() == F.col("split.at")), F.col("split.left"))
    copies = F.col("whole") + F.when(more, 1).otherwise(0)
    rows = rows.withColumn("copies", F.least(copies, F.lit(most)).cast("long")).withColumn("some", some)
    return rows.drop("s", "c", "docs", "words", "n", "b", "last", "split", "whole", "rank", "slice")


def _one_by_one(ties: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows with copies (``name``) and ``some``: of the rows of one key the first ``some`` take one more, in the order of the parts they are written in."""
    columns = [c for c in ties.columns if c != "some"]
    ties = materialize(ties.withColumn("__id", F.monotonically_increasing_id()), "mix-ties").withColumn("__part", F.shiftright("__id", 33))
    counts = ties.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*[F.col(k).alias(f"__k{j}") for j, k in enumerate(keys)], F.col("__part").alias("__p"), F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy("__id"))
    on = F.col("__part") == F.col("__p")
    for j, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{j}"))
    ties = ties.withColumn("__place", place).join(counts, on)
    return ties.withColumn(name, F.col(name) + F.when(F.col("__before") + F.col("__place") <= F.col("some"), 1).otherwise(0)).select(*columns)


def _uniform(seed: str) -> Column:
    """BITS bits of a keyed hash of doc_id, or without one of the text; the same on every run."""
    named = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("null:"), F.xxhash64("text").cast("string")))
    return F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), named), 256), 1, BITS // 4), 16, 10).cast("long")


def _tie(text: Column) -> Column:
    return F.coalesce(F.xxhash64(text), F.lit(0))


def _sized(docs: DataFrame, seed: str) -> DataFrame:
    size = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), _uniform(seed).alias("h"), _tie(F.col("text")).alias("tie"))


def mix_report(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs; also copies, the whole documents that the mix takes."""
    rows = _decided(materialize(_sized(docs, seed), "mix-sizes"), weights, most)
    plain, ties = rows.where("some IS NULL").drop("some"), rows.where("some IS NOT NULL")
    rows = plain if ties.isEmpty() else plain.unionByName(_one_by_one(ties, ["doc_id", "source", "tie"], "copies"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mixture itself: rows of docs, all columns kept, each as often as the mix takes it."""
    rows = _decided(materialize(_sized(docs, seed), "mix-sizes"), weights, most)
    keys = [F.col(c).alias(f"__llm_{c}") for c in ("doc_id", "source", "tie")]
    # Rows of one key share copies and some.
    copies = rows.groupBy(*keys).agg(F.max("copies").alias("__llm_copies"), F.max("some").alias("some")).where("__llm_copies > 0 OR some > 0")
    copies = materialize(copies.withColumnRenamed("some", "__llm_some"), "mix-copies")
    named = docs["doc_id"].cast("long").eqNullSafe(F.col("__llm_doc_id")) & docs["source"].cast("string").eqNullSafe(F.col("__llm_source")) & (_tie(docs["text"]) == F.col("__llm_tie"))
    columns = [docs[c].alias(f"__c{k}") for k, c in enumerate(docs.columns)]

    def joined(found: DataFrame, *more: str) -> DataFrame:
        return docs.join(found, named).select(*columns, "__llm_copies", *more)

    out = joined(copies.where("__llm_some IS NULL"))
    split = copies.where("__llm_some IS NOT NULL")
    n = split.count()
    if n:  # at most one key of each class
        ties = joined(F.broadcast(split) if n <= BROADCAST_ROWS else split, "__llm_doc_id", "__llm_source", "__llm_tie", F.col("__llm_some").alias("some"))
        ties = _one_by_one(ties, ["__llm_doc_id", "__llm_source", "__llm_tie"], "__llm_copies")
        out = out.unionByName(ties.select(*out.columns).where("__llm_copies > 0"))
    out = out.withColumn("__llm_n", F.explode(F.sequence(F.lit(1), F.col("__llm_copies").cast("int"))))
    return out.select(*[F.col(f"__c{k}").alias(c) for k, c in enumerate(docs.columns)])


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(sha256('mix-1:' || doc_id::VARCHAR), 1, 13))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY 3 * source_size / w::DOUBLE, source ASC NULLS LAST) AS k, 3 * source_size AS cap FROM s
), c AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
          / ((sum(w) OVER ())::DOUBLE - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) AS level
  FROM r
), f AS (
  SELECT min(k) AS first, arg_min(level, k) AS level FROM c WHERE level * w <= cap
), t AS (
  SELECT source, source_size, CASE WHEN f.first IS NULL OR k < f.first THEN cap::DOUBLE ELSE least(f.level * w, cap::DOUBLE) END AS target FROM c, f
), j AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole,
         CASE WHEN size > 0 THEN (length(bin(size)) - 1) * 8 + ((size * 8) // (1::BIGINT << (length(bin(size)) - 1)) - 8) ELSE -1 END AS cl
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), g AS (
  SELECT source, cl, count(*) AS docs, sum(size)::BIGINT AS words, greatest(0.0::DOUBLE, any_value(target - whole * source_size)) * sum(size)::BIGINT / any_value(source_size) AS rest,
         row_number() OVER (PARTITION BY source ORDER BY cl DESC) AS i
  FROM j WHERE size > 0 GROUP BY source, cl
), n1 AS (
  SELECT source, cl, i, docs, words, words / docs AS mean, least(docs, greatest(0, floor(rest / (words / docs) + 0.5)::BIGINT)) AS n,
         rest - least(docs, greatest(0, floor(rest / (words / docs) + 0.5)::BIGINT)) * (words / docs) AS over
  FROM g WHERE i = 1
  UNION ALL
  SELECT g.source, g.cl, g.i, g.docs, g.words, g.words / g.docs, least(g.docs, greatest(0, floor((n1.over + rest) / (g.words / g.docs) + 0.5)::BIGINT)),
         n1.over + rest - least(g.docs, greatest(0, floor((n1.over + rest) / (g.words / g.docs) + 0.5)::BIGINT)) * (g.words / g.docs)
  FROM n1 JOIN g ON g.source IS NOT DISTINCT FROM n1.source AND g.i = n1.i + 1
), o AS (
  SELECT source, arg_max(over, i) AS over FROM n1 GROUP BY source
), n AS (
  SELECT n1.source, cl, i, words, n + least(docs - n, greatest(-n, floor(o.over / mean + 0.5)::BIGINT)) AS n,
         o.over - least(docs - n, greatest(-n, floor(o.over / mean + 0.5)::BIGINT)) * mean AS over
  FROM n1 JOIN o ON o.source IS NOT DISTINCT FROM n1.source WHERE i = 1
  UNION ALL
  SELECT n1.source, n1.cl, n1.i, n1.words, n1.n + least(n1.docs - n1.n, greatest(-n1.n, floor(n.over / n1.mean + 0.5)::BIGINT)),
         n.over - least(n1.docs - n1.n, greatest(-n1.n, floor(n.over / n1.mean + 0.5)::BIGINT)) * n1.mean
  FROM n JOIN n1 ON n1.source IS NOT DISTINCT FROM n.source AND n1.i = n.i + 1
), p AS (
  SELECT j.*, n.n, least(n.n * j.size / n.words, 1 - 2.0::DOUBLE ** -40) AS p, (h + 0.5::DOUBLE) * 2.0::DOUBLE ** -52 AS u
  FROM j LEFT JOIN n ON j.source IS NOT DISTINCT FROM n.source AND j.cl = n.cl
), k AS (
  SELECT *, CASE WHEN coalesce(n, 0) > 0
    AND row_number() OVER (PARTITION BY source, cl ORDER BY CASE WHEN n > 0 THEN (u / (1 - u)) / (p / (1 - p)) END, doc_id, size) <= n THEN 1 ELSE 0 END AS more
  FROM p
)
SELECT doc_id, size, source_size, target, (whole + more) * size AS taken, whole + more AS copies FROM k
"""
