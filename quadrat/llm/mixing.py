"""Mixing sources to target weights by Pareto order sampling.

A document of a source whose target is r times its size has ``floor(r)`` certain whole
copies.  What is left of the target is a sample of further copies, of fixed size in
words, with unequal probabilities: the inclusion probability of a document is in
proportion to the bit length of its size, 1 at most, and such that the expected words
are those left.  Documents of probability 1 are taken; of the others those that come
first by Pareto's ranking variable, (U / (1 - U)) / (p / (1 - p)), U being a random
number fixed by the document's id and p its inclusion probability, until the words
taken are nearest to the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.llm.common import WORD, keep

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Buckets of the ranking variable in a round of the search for the cut.
BUCKETS = 256


def uniform(key: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the key's MD5."""
    bits = F.conv(F.substring(F.md5(key.cast("string")), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def targets(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """Add ``target``: ``share`` of all words dealt by weight, at most ``cap`` x size.

    ``sources`` has ``weight`` and ``source_size``, one row per source.  What a
    capped source cannot take is dealt again by weight.  Every round is one
    aggregation; the driver holds three numbers.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    limit = F.col("source_size") * cap
    level, before = -1.0, None
    while True:
        full = F.col("weight") * level > limit
        taken, weight, n = sources.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)),
            F.count(F.when(full, 1)),
        ).first()
        if n == before:
            break
        before = n
        if not weight:
            level = float("inf")
            break
        level = (total * share - taken) / weight
    want = F.least(F.col("weight") * F.lit(level), limit)
    return sources.withColumn("target", F.when(F.col("source_size") == 0, 0.0).otherwise(want))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """(i, none, s, size, bits, u, *more): what the mix needs of each row."""
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(
        F.col(id_col).alias("i"),
        F.col(source_col).isNull().alias("none"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("s"),
        words.alias("size"),
        F.when(words > 0, F.length(F.bin(words))).otherwise(0).alias("bits"),
        uniform(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("u"),
        *more,
    )


def inclusion(classes: DataFrame) -> DataFrame:
    """Add ``p`` to a row per source and bit length: ``level`` x bits, 1 at most.

    ``classes`` has ``words``, those of the class, and ``rest``, those the source still
    takes.  The expected words for a level are the least of the sums in which the
    classes from some bit length on are certain, so the level is the greatest of those
    that fit such a sum.
    """
    keys = ["none", "s"]
    one = classes.select(*keys, F.col("bits").alias("b"), F.col("words").alias("w"))
    froms = classes.select(*keys, "rest", F.col("bits").alias("from")).union(classes.select(*keys, "rest", F.lit(99)).distinct())
    sums = froms.join(one, keys).groupBy(*keys, "rest", "from").agg(
        F.sum(F.when(F.col("b") >= F.col("from"), F.col("w")).otherwise(0)).alias("certain"),
        F.sum(F.when(F.col("b") < F.col("from"), F.col("w") * F.col("b")).otherwise(0)).alias("open"),
    )
    level = sums.where("open > 0").groupBy(*keys).agg(F.max((F.col("rest") - F.col("certain")) / F.col("open")).alias("level"))
    p = F.when(F.col("rest") > 0, F.least(F.lit(1.0), F.coalesce("level", F.lit(0.0)) * F.col("bits"))).otherwise(0.0)
    return classes.join(level, keys, "left").withColumn("p", p).drop("level")


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """A row per source and bit length: the source's size, target and last row taken, whole copies, inclusion probability."""
    keys = ["none", "s"]
    classes = keep(sized.groupBy(*keys, "bits").agg(F.sum("size").alias("words")), "mix-classes")
    sources = classes.groupBy(*keys).agg(F.sum("words").alias("source_size"))
    # One row per source; their order fixes the weights.
    order = F.row_number().over(Window.orderBy("none", "s")) - 1
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (order % len(weights) + 1).cast("int"))
    dealt = targets(keep(sources.withColumn("weight", pick), "mix-weights"), share, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio)
    rest = (F.col("target") - whole * F.col("source_size")).alias("rest")
    dealt = dealt.select(*keys, "source_size", "target", whole.alias("whole"), rest)
    dealt = keep(inclusion(classes.join(dealt, keys)), "mix-dealt")
    # what the certain further copies leave
    left = dealt.groupBy(*keys).agg((F.first("rest") - F.sum(F.when(F.col("p") >= 1, F.col("words")).otherwise(0))).alias("left"))
    ranks = sized.join(dealt.where("p > 0 and p < 1").join(left, keys), [*keys, "bits"]).select(*keys, "i", "size", _pareto().alias("q"), F.col("left").alias("rest"))
    cut = _cut(keep(ranks, "mix-ranks"))
    return keep(dealt.drop("words", "rest").join(cut, keys, "left"), "mix-plan")


def _pareto() -> Column:
    odds = F.col("u") * (1 - F.col("p")) / ((1 - F.col("u")) * F.col("p"))
    return F.when((F.col("p") > 0) & (F.col("p") < 1), odds)


def _copies() -> Column:
    """Copies of a row that was joined with its source's plan."""
    q = _pareto()
    upto = (q < F.col("cut_q")) | ((q == F.col("cut_q")) & (F.struct("i", "size") <= F.struct("cut_i", "cut_size")))
    return F.col("whole") + F.coalesce((F.col("p") >= 1) | upto, F.lit(False)).cast("int")


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
) -> DataFrame:
    """(id, size, source_size, target, taken) of every row of ``docs``.

    ``size`` counts the words of the text; ``taken`` is the words the mix takes
    of the row, 0, 1 or more whole copies of ``size``, at most ``cap`` copies.
    Sources by code point take ``weights`` in turn, a null source comes last.
    Each source's taken words are off its target by half a document at most.

    Null and empty texts have size 0 and take 0.  Equal ranks (repeated rows)
    fall in order of id, then size, and are taken together.  A source without
    words has target 0.  An empty table gives an empty result; other columns are
    ignored.
    """
    sized = keep(_keyed(docs, id_col, text_col, source_col), "mix-sizes")
    rows = sized.join(plan(sized, weights, share, cap), ["none", "s", "bits"])
    taken = (_copies() * F.col("size")).cast("long")
    return rows.select(F.col("i").alias(id_col), "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns as they are, each as often as it is taken.

    The plan has a row per source and bit length, so the rows meet it without a shuffle as long as
    it is small; beyond that adaptive execution splits a hot source.
    """
    chosen = plan(keep(_keyed(docs, id_col, text_col, source_col), "mix-sizes"), weights, share, cap)
    rows = _keyed(docs, id_col, text_col, source_col, F.struct("*").alias("row")).join(chosen, ["none", "s", "bits"])
    times = rows.select("row", _copies().cast("int").alias("n")).where("n > 0")
    return times.select("row", F.explode(F.sequence(F.lit(1), "n"))).select("row.*")


def _cut(ranks: DataFrame, rounds: int = 2) -> DataFrame:
    """(none, s, cut_q, cut_i, cut_size): the last row by (q, i, size) each source takes.

    A row is taken while the words before it and half its own fit in ``rest``.
    The search goes by sums of buckets of q, and only the rows of the bucket
    that holds the cut are put in order: after ``rounds`` rounds, 1 row in
    ``BUCKETS ** rounds`` of a source.
    """
    keys = ["none", "s"]
    left = ranks.where("q is not null").select(*keys, "i", "size", "q", "rest", (F.col("q") / (1 + F.col("q"))).alias("x"))
    passed = []
    for _ in range(rounds):
        # x runs over [0, 1) and is stretched to the bucket of the cut each round
        b = F.least(F.floor(F.col("x") * BUCKETS), F.lit(BUCKETS - 1))
        left = left.withColumn("b", b)
        sums = left.groupBy(*keys, "b").agg(
            F.sum("size").alias("n"),
            F.first("rest").alias("rest"),
            F.max(F.struct("q", "i", "size")).alias("last"),
        )
        upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
        sums = keep(sums.withColumn("upto", upto), "mix-buckets")
        passed.append(sums.where("upto <= rest").select(*keys, "last"))
        edge = sums.where("upto > rest").groupBy(*keys).agg(
            F.min(F.struct("b", (F.col("rest") - F.col("upto") + F.col("n")).alias("rest"))).alias("e")
        )
        edge = edge.select(*keys, F.col("e.b").alias("b"), F.col("e.rest").alias("rest"))
        left = keep(left.drop("rest").join(edge, [*keys, "b"]).withColumn("x", F.col("x") * BUCKETS - F.col("b")), "mix-edge")
    w = Window.partitionBy(*keys).orderBy("q", "i", "size")
    upto = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))
    fine = left.withColumn("upto", upto).where(F.col("upto") - F.col("size") / 2 <= F.col("rest"))
    passed.append(fine.select(*keys, F.struct("q", "i", "size").alias("last")))
    found = passed[0]
    for more in passed[1:]:
        found = found.unionByName(more)
    found = found.groupBy(*keys).agg(F.max("last").alias("l"))
    return found.select(*keys, F.col("l.q").alias("cut_q"), F.col("l.i").alias("cut_i"), F.col("l.size").alias("cut_size"))


#: The same result for unique ids, for DuckDB.
MIX_SQL = """
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         (CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT source, source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sources),
levels(k, level) AS (
  SELECT 0, CAST(-1 AS DOUBLE)
  UNION ALL
  SELECT k + 1, (SELECT (1.5 * sum(source_size) - coalesce(sum(CASE WHEN weight * l.level > 2 * source_size THEN 2 * source_size END), 0))
                 / sum(CASE WHEN weight * l.level > 2 * source_size THEN 0 ELSE weight END) FROM weighted)
  FROM levels l WHERE k < 40),
dealt AS (
  SELECT source, source_size, target, floor(ratio) AS whole, target - floor(ratio) * source_size AS rest
  FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio
        FROM (SELECT source, source_size, least(weight * (SELECT level FROM levels WHERE k = 40), 2 * source_size) AS target FROM weighted))),
classes AS (
  SELECT s.source, coalesce(floor(log2(nullif(size, 0))) + 1, 0)::BIGINT AS bits, sum(size)::BIGINT AS words, any_value(rest) AS rest
  FROM sized s JOIN dealt d ON s.source IS NOT DISTINCT FROM d.source GROUP BY ALL),
froms AS (
  SELECT source, rest, bits AS k FROM classes UNION ALL SELECT DISTINCT source, rest, 99 FROM classes),
slopes AS (
  SELECT source, max(CASE WHEN open > 0 THEN (rest - certain) / open END) AS slope
  FROM (SELECT f.source, f.rest, f.k, CAST(sum(CASE WHEN bits >= k THEN words ELSE 0 END) AS DOUBLE) AS certain,
               CAST(sum(CASE WHEN bits < k THEN words * bits ELSE 0 END) AS DOUBLE) AS open
        FROM froms f JOIN classes c ON f.source IS NOT DISTINCT FROM c.source GROUP BY ALL) GROUP BY source),
chances AS (
  SELECT c.source, bits, words, CASE WHEN rest > 0 THEN least(1.0::DOUBLE, coalesce(slope, 0) * bits) ELSE 0.0 END AS p
  FROM classes c JOIN slopes l ON c.source IS NOT DISTINCT FROM l.source),
lefts AS (
  SELECT source, CAST(sum(CASE WHEN p >= 1 THEN words ELSE 0 END) AS DOUBLE) AS sure FROM chances GROUP BY source),
ranked AS (
  SELECT s.doc_id, s.size, d.source, d.source_size, d.target, d.whole, d.rest - l.sure AS rest, c.p,
         CASE WHEN c.p > 0 AND c.p < 1 THEN u * (1 - c.p) / ((1 - u) * c.p) END AS q
  FROM sized s JOIN dealt d ON s.source IS NOT DISTINCT FROM d.source
  JOIN chances c ON s.source IS NOT DISTINCT FROM c.source AND c.bits = coalesce(floor(log2(nullif(s.size, 0))) + 1, 0)
  JOIN lefts l ON s.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST((whole + CASE WHEN p >= 1 OR (q IS NOT NULL AND upto - size / 2 <= rest) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM (SELECT *, CAST(sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, doc_id, size ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS upto FROM ranked)
"""
