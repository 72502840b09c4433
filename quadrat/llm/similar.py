"""Near duplicates by the similarity of word shingles, SimHash candidates first.

SimHash proposes pairs within its radius.  Texts of Jaccard similarity ``LEAST`` differ
in ten bits of 64 as a rule, far beyond any radius that a grid can answer, so pairs are
proposed by bands of minima as well: of two sets of similarity s, a band of ``ROWS``
independent minimum hashes agrees with probability s ** ROWS, so one of ``BANDS`` does
with 1 - (1 - s ** ROWS) ** BANDS: of pairs at the threshold 6 in a million are not
proposed, of more similar ones fewer.  The shingles themselves decide.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm import simhash
from quadrat.llm.common import by_bytes, keep, tidy
from quadrat.llm.components import components
from quadrat.llm.passages import numbers

#: Words of a shingle, least similarity.
WIDTH, LEAST = 5, 0.8
#: Bands of a signature, minimum hashes in each.
BANDS, ROWS = 30, 5
#: Texts that share a band and are paired; more are compared with the least of their size
#: first, and those still apart by their rarest shingles.
MOST = 8
#: Further rounds for texts left apart from most that share a band, and members of each
#: size that they meet in each of their bands then.
ROUNDS, PICKS = 3, 4
#: Bytes of text that a task hashes at once, about.
SLICE = 1 << 20


def shingle_set(text: str, width: int = WIDTH) -> set[bytes]:
    return set(simhash.shingles(text, width))


def similarity(a: set, b: set) -> float:
    """Jaccard similarity; two empty sets are alike."""
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


_RANDOM = np.random.default_rng(29).integers(1, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)


def signature(h: np.ndarray) -> np.ndarray:
    """The bands (longs) of a set of shingle hashes; none of an empty set."""
    if not len(h):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 4096):
        x = (h[None, at : at + 4096] ^ _RANDOM[0]) * _RANDOM[1]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        least = np.minimum(least, x.min(axis=1))
    band = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        band = (band ^ row) * np.uint64(0x9E3779B97F4A7C15)
        band ^= band >> np.uint64(29)
    return band.view(np.int64)


def _hashed(texts: list[list[bytes]], width: int) -> list[np.ndarray]:
    """A hash of each shingle of each text, repeats included."""
    n, ends = numbers(texts)
    h = np.zeros(max(len(n) - width + 1, 0), np.uint64)
    for k in range(width if len(h) else 0):
        h = (h + n[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    out = []
    for at, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if end - at >= width or end == at:
            out.append(h[at : max(end - width + 1, at)])
        else:  # the whole sequence is one shingle
            out.append(np.bitwise_xor.reduce(n[at:end] * np.arange(3, 2 * (end - at) + 3, 2, np.uint64), keepdims=True))
    return out


def _looked_at(rows: DataFrame, width: int) -> DataFrame:
    """(tag, key, fp, n, bands) of rows (tag, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in by_bytes(b, 1, SLICE):
                split = [simhash.words(t or "") for t in some.column(1).to_pylist()]
                keys = [hashlib.md5(b" ".join(w)).hexdigest() for w in split]
                first = {k: n for n, k in reversed(list(enumerate(keys)))}
                made = {k: h for k, h in zip(first, _hashed([split[n] for n in first.values()], width))}
                sets = {k: np.unique(h) for k, h in made.items()}
                prints, bands = {k: simhash.majority(h) for k, h in made.items()}, {k: signature(h) for k, h in sets.items()}
                fp = pa.array(np.array([prints[k] for k in keys], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(keys), fp, pa.array([len(sets[k]) for k in keys], pa.int32()), pa.array([bands[k] for k in keys], pa.list_(pa.int64()))], names=["tag", "key", "fp", "n", "bands"])

    return rows.select("tag", "t").mapInArrow(tidy(run), "tag bigint, key string, fp bigint, n int, bands array<bigint>")


def _placed(nodes: DataFrame, least: float) -> DataFrame:
    """(h, k, node, n, step) of the bands that k > 1 nodes share; ``step`` is the logarithm of the size."""
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(least))).cast("int")
    placed = nodes.select("node", "n", step.alias("step"), F.explode("bands").alias("h"))
    sizes = keep(placed.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"), "similar-bands")
    return keep(placed.join(sizes, "h"), "similar-met")


def _ordered(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _candidates(nodes: DataFrame, met: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: pairs of nodes that may be similar."""
    # by SimHash: nodes of one fingerprint with the least of them, and near fingerprints' least
    prints = keep(nodes.groupBy("fp").agg(F.min("node").alias("low")), "similar-prints")
    same = nodes.join(prints, "fp").where("node != low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    near = simhash.links(prints.select("fp"))
    ends = lambda c: prints.select(F.col("fp").alias(c), F.col("low").alias(f"low_{c}"))
    near = near.join(ends("a"), "a").join(ends("b"), "b").select(*_ordered("low_a", "low_b"))
    # by band: sizes differ by a factor of 1 / least at most, so by one step of the logarithm
    small = met.where(F.col("k") <= MOST).groupBy("h").agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("m"))
    small = small.select("m", F.explode("m").alias("x")).select("x", F.explode(F.filter("m", lambda y: (y["node"] > F.col("x.node")) & (F.least(y["n"], F.col("x.n")) >= F.greatest(y["n"], F.col("x.n")) * F.lit(least)))).alias("y"))
    small = small.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    # many that share a band meet the least of their size, and of the sizes beside it
    large = met.where(F.col("k") > MOST)
    low = keep(_around(large.groupBy("h", "step").agg(F.array(F.min("node")).alias("x"))), "similar-low")
    wide = _met_there(large, low).select(*_ordered("node", "other"))
    return same.union(near).union(small).union(wide).distinct()


def _around(steps: DataFrame) -> DataFrame:
    """(h, step, near): the nodes that arrays ``x`` of (h, step, x) name for a step and those beside it.

    The rows of the steps are repeated for their neighbours, not those of the nodes.
    """
    beside = F.explode(F.array(F.col("step") - 1, "step", F.col("step") + 1))
    return steps.select("h", beside.alias("step"), "x").groupBy("h", "step").agg(F.array_distinct(F.flatten(F.collect_list("x"))).alias("near"))


def _met_there(rows: DataFrame, around: DataFrame) -> DataFrame:
    """(node, other) of rows (h, step, node) and the other nodes near their step."""
    return rows.join(around, ["h", "step"]).select("node", F.explode(F.filter("near", lambda x: x != F.col("node"))).alias("other"))


def _with_groups(met: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(h, node, n, step, group) of bands that many share, and those of it outside the largest group of a band."""
    large = met.where(F.col("k") > MOST).join(found.withColumnRenamed("root", "group"), "node", "left").select("h", "node", "n", "step", F.coalesce("group", "node").alias("group"))
    top = large.groupBy("h", "group").agg(F.count("*").alias("c")).groupBy("h").agg(F.max(F.struct("c", "group")).alias("top"))
    return large, large.join(keep(top, "similar-top"), "h").where("group != top.group").drop("top")


def _left_apart(met: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b): more pairs for the nodes outside the largest group of many that share a band."""
    large, out = _with_groups(met, found)
    picks = F.array(*[F.min(F.struct(F.xxhash64("node", "h", F.lit(k)), "node"))["node"] for k in range(PICKS)])
    picks = keep(_around(large.groupBy("h", "step").agg(picks.alias("x"))), "similar-picks")
    return _met_there(out, picks).select(*_ordered("node", "other")).distinct()


def _apart(met: DataFrame, found: DataFrame, texts: DataFrame, least: float, width: int) -> DataFrame:
    """(a, b): all pairs that many share a band with, are of two groups and may be similar.

    Of a set's shingles, rarest first, a similar set holds one of the first ``n - least *
    n + 1``; the places of the first that two sets have in common bound what they have in
    common in all, and no pair beyond that bound is left out.
    """
    large, out = _with_groups(met, found)
    out = keep(out.select("h", "node"), "similar-out")
    mixed = large.join(out.select("h").distinct(), "h", "left_semi").select("node", "n", "group").distinct()
    mixed = keep(mixed.join(out.select("node", F.lit(True).alias("out")).distinct(), "node", "left").withColumn("out", F.coalesce("out", F.lit(False))), "similar-mixed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in by_bytes(b, 1, SLICE):
                sets = [np.unique(h) for h in _hashed([simhash.words(t) for t in some.column(1).to_pylist()], width)]
                ids = some.column(0).take(pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets])))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(sets).view(np.int64))], names=["node", "x"])

    shingles = keep(texts.join(mixed.select("node"), "node", "left_semi").select("node", "t").mapInArrow(tidy(run), "node bigint, x bigint"), "similar-shingles")
    ranked = shingles.join(shingles.groupBy("x").agg(F.count("*").alias("c")), "x").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("c", "x"))).alias("x"))
    # gathered per document: its own shingles
    prefix = F.slice("x", F.lit(1), F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9).cast("int") + 1)
    first = ranked.join(mixed, "node").select("node", "n", "group", "out", F.posexplode(prefix).alias("at", "x")).where("x.c > 1")
    first = keep(first.select("node", "n", "group", "out", F.col("x.x").alias("x"), (F.col("n") - F.col("at")).alias("rest")), "similar-first")
    one = first.where("out").select("x", F.col("node").alias("v"), F.col("n").alias("m"), F.col("group").alias("g"), F.col("rest").alias("u"))
    may = F.least("rest", "u") >= (F.col("n") + F.col("m")) * F.lit(least / (1 + least)) - 1e-9
    near = F.least("n", "m") >= F.greatest("n", "m") * F.lit(least) - 1e-9
    return first.join(one, (first["x"] == one["x"]) & (F.col("group") != F.col("g")) & near & may).select(*_ordered("node", "v")).distinct()


def groups(nodes: DataFrame, texts: DataFrame, least: float = LEAST, width: int = WIDTH) -> DataFrame:
    """(node, root): the components of ``nodes`` (node, fp, n, bands) whose ``texts`` (node, t) are similar."""
    met = _placed(nodes, least)
    asked = keep(_candidates(nodes, met, least), "similar-candidates")
    edges = keep(_verified(asked, texts, least, width), "similar-edges")
    found = components(edges)
    for _ in range(0 if met.where(F.col("k") > MOST).isEmpty() else ROUNDS):
        found = keep(found, "similar-found")
        more = keep(_left_apart(met, found).join(asked, ["a", "b"], "left_anti"), "similar-more")
        new = keep(_verified(more, texts, least, width), "similar-edges")
        if new.isEmpty():
            break
        asked, edges = asked.union(more), edges.union(new)
        found = components(edges)
    if not met.where(F.col("k") > MOST).isEmpty():
        found = keep(found, "similar-found")
        more = keep(_apart(met, found, texts, least, width).join(asked, ["a", "b"], "left_anti"), "similar-more")
        new = keep(_verified(more, texts, least, width), "similar-edges")
        if not new.isEmpty():
            found = components(edges.union(new))
    return found


def _verified(pairs: DataFrame, texts: DataFrame, least: float, width: int) -> DataFrame:
    """The similar ones of ``pairs`` (a, b)."""
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = keep(texts.join(asked.hint("merge"), "node", "left_semi"), "similar-texts")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stays: list[bool] = []
            known: dict[int, set] = {}
            for at in range(0, b.num_rows, 200):
                some = b.slice(at, 200)
                for i, j, t, u in zip(*(c.to_pylist() for c in some.columns)):
                    if len(known) > 500:
                        known.clear()
                    for node, text in ((i, t), (j, u)):
                        if node not in known:
                            known[node] = shingle_set(text, width)
                    stays.append(similarity(known[i], known[j]) >= least - 1e-12)
            yield b.select(["a", "b"]).filter(pa.array(stays, pa.bool_()))

    here, there = texts.select(F.col("node").alias("a"), F.col("t").alias("x")), texts.select(F.col("node").alias("b"), F.col("t").alias("y"))
    return pairs.join(here, "a").join(there, "b").select("a", "b", "x", "y").mapInArrow(tidy(verified), "a bigint, b bigint")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """The rows of ``docs``, all columns as they are, with one row of each group of near duplicates.

    Two texts are linked if their sets of ``width``-word shingles have a Jaccard
    similarity of ``least`` or more (fewer words are one shingle; words as in
    ``simhash``); groups are the components.  Texts of equal words are one node, and in
    a band of over ``MOST`` nodes each is compared with the least nodes of like size
    first; nodes that stay apart from most of those they share a band with meet
    ``PICKS`` more in every band, in rounds while that links any, and in the end all
    of another group that their rarest shingles leave possible.  So the work follows
    the texts, not the pairs of a group, and no pair of two groups that share a band is left out.

    The row of least id stays, a null id only if its group has no other; of repeated
    ids one row stays.  Null, empty and blank texts are alike.  Very long texts are read
    whole.  An empty table gives an empty result; clashing names do no harm.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.monotonically_increasing_id().alias("tag"))
    rows = keep(rows, "similar-rows")  # from here on a row's tag is fixed
    looked = keep(_looked_at(rows, width), "similar-looked")
    keys = keep(looked.groupBy("key").agg(F.min("tag").alias("node")), "similar-keys")
    nodes = keep(looked.join(keys.select(F.col("node").alias("tag")), "tag", "left_semi").select(F.col("tag").alias("node"), "fp", "n", "bands"), "similar-nodes")
    found = groups(nodes, rows.select(F.col("tag").alias("node"), F.coalesce("t", F.lit("")).alias("t")), least, width)
    rooted = keys.join(found, "node", "left").select("key", F.coalesce("root", "node").alias("root"))
    first = F.min(F.struct(F.col("i").isNull(), "i", "tag")).alias("x")
    stays = looked.select("tag", "key").join(rooted, "key").select("tag", "root").join(rows.select("tag", "i"), "tag").groupBy("root").agg(first).select("x.tag")
    # the set of rows that stay grows with the rows: it is shuffled at any size
    return rows.join(keep(stays, "similar-stays").hint("merge"), "tag", "left_semi").select("row.*")
