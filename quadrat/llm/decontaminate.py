"""Benchmark decontamination by SimHash windows of the items' own sizes.

A document is read in windows as long as an item.  Windows and items have fingerprints
of ``BITS`` bits over their weighted shingles; a multi-index over blocks of the
fingerprint finds every item within ``RADIUS`` bits of a window, and the similarity of
the weighted shingles, of at least ``LEAST``, decides.  Two fingerprints within r bits
have one of m blocks within r // m bits, and that block again has one of k parts within
r // m // k bits: parts are looked up, blocks and whole fingerprints are counted.  Of
fingerprints by chance one in 500 has a near block.  Texts of similarity ``LEAST`` differ
in 39 bits of 256 on average with a deviation of 6, so ``RADIUS`` is beyond what the
similarity lets through.

A window that similar shares a shingle with the item, near the place the item has
it.  So only windows about such places are fingerprinted; that skips nothing.

Weights, equal items and windows are those of the whole benchmark, however many
blocks it is searched in: the windows that any block asks for are gathered first, and
the weights of their shingles are looked up in the table of all that recur.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import keep, tidy

#: Words of a shingle, least similarity.
WIDTH, LEAST = 5, 0.8
#: Bits of a fingerprint, of the search radius; blocks, and parts of a block, each an octet.
BITS, RADIUS, BLOCKS, PARTS = 256, 62, 8, 4
#: Items and bytes of item text that are searched at once.
MOST_ITEMS, MOST_BYTES = 10_000, 16 << 20
_WORDS = re.compile(r"[^\W_]+").findall


def words(text: str) -> list[str]:
    return _WORDS(text.lower())


def shingles(found: list[str]) -> list[str]:
    """Runs of ``WIDTH`` words; fewer words are one shingle."""
    if len(found) <= WIDTH:
        return [" ".join(found)] if found else []
    return [" ".join(x) for x in zip(*(found[k : len(found) - WIDTH + 1 + k] for k in range(WIDTH)))]


def _hashes(found: list[str]) -> np.ndarray:
    """Octets (shingles, BITS // 8) of the shingles' hashes."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    octets = [b.encode("utf-8", "surrogatepass") for b in found]
    return np.frombuffer(b"".join(digest(b, seed) for b in octets for seed in range(42, 42 + BITS // 128)), np.uint8).reshape(len(found), BITS // 8)


def fingerprint(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Octets of a fingerprint: a bit is 1 if it is set in over half of the weight."""
    bits = np.unpackbits(hashes, axis=1, bitorder="little")
    return np.packbits(weights @ bits > weights.sum() / 2, bitorder="little")


def similarity(a: Counter, b: Counter, weight) -> float:
    """Weighted Jaccard similarity of two bags of shingles."""
    both = sum(min(n, b[s]) * weight(s) for s, n in a.items() if s in b)
    return both / (sum(n * weight(s) for s, n in a.items()) + sum(n * weight(s) for s, n in b.items()) - both)


@dataclass
class Index:
    """The items of one block, weights in the whole benchmark, and what a search of documents needs."""

    ids: list
    texts: list[list[str]]
    weights: dict[str, float]
    most: float
    vocabulary: dict[str, int] = field(default_factory=dict)
    places: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    short: dict[str, list[int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.bags = [Counter(shingles(t)) for t in self.texts]
        self.prints = np.zeros((len(self.ids), BITS // 8), np.uint8)
        for k, t in enumerate(self.texts):
            found = shingles(t)
            self.prints[k] = fingerprint(_hashes(found), np.array([self.weight(s) for s in found]))
            if len(t) < WIDTH:
                self.short.setdefault(t[0], []).append(k)
                continue
            n = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in t]
            for q, code in enumerate(_codes(np.array(n, np.uint64)).tolist()):
                self.places.setdefault(code, []).append((k, q))
        self.codes = np.array(sorted(self.places), np.uint64)
        # near[octet][value]: items whose octet is within RADIUS // BLOCKS // PARTS bits of value
        apart = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None, None] ^ self.prints[None])
        self.near = np.packbits(apart.transpose(2, 0, 1) <= RADIUS // BLOCKS // PARTS, axis=2)

    def weight(self, shingle: str) -> float:
        return self.weights.get(shingle, self.most)

    def candidates(self, fp: np.ndarray) -> np.ndarray:
        """Items with a block within RADIUS // BLOCKS bits of the fingerprint's."""
        parts = self.near[np.arange(BITS // 8), fp].reshape(BLOCKS, PARTS, -1)
        block, item = np.nonzero(np.unpackbits(np.bitwise_or.reduce(parts, axis=1), axis=1, count=len(self.ids)))
        mine = self.prints.reshape(-1, BLOCKS, PARTS)[item, block]
        apart = np.bitwise_count(mine ^ fp.reshape(BLOCKS, PARTS)[block]).sum(axis=1)
        return np.unique(item[apart <= RADIUS // BLOCKS])

    def within(self, fp: np.ndarray) -> list[tuple[int, int]]:
        """(item, distance) of every item within RADIUS bits."""
        some = self.candidates(fp)
        apart = np.bitwise_count(self.prints[some] ^ fp).sum(axis=1)
        return [(int(k), int(d)) for k, d in zip(some, apart) if d <= RADIUS]

    def starts(self, found: list[str]) -> set[tuple[int, int]]:
        """(first word, words) of the windows that may hold an item."""
        get = self.vocabulary.get
        n = np.fromiter((get(w, 0) for w in found), np.uint64, len(found))
        out: set[tuple[int, int]] = set()
        if len(found) >= WIDTH and len(self.codes):
            known = n != 0
            full = known[: len(n) - WIDTH + 1].copy()
            for k in range(1, WIDTH):
                full &= known[k : len(n) - WIDTH + 1 + k]
            at = np.flatnonzero(full)
            if len(at):
                code = _codes(n)[at]
                slot = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                hit = self.codes[slot] == code
                for p, c in zip(at[hit].tolist(), code[hit].tolist()):
                    for k, q in self.places[c]:
                        size = len(self.texts[k])
                        # a shift by d words costs d shingles at either end
                        slack = int((size - WIDTH + 1) * (1 - LEAST) / (1 + LEAST)) + 1
                        first = min(max(p - q, 0), max(len(found) - size, 0))
                        out.update((s, size) for s in range(max(first - slack, 0), min(first + slack, max(len(found) - size, 0)) + 1))
        for w, items in self.short.items():
            if w in found:
                for k in items:
                    size = len(self.texts[k])
                    out.update((s, size) for s in range(len(found) - size + 1) if found[s] == w)
        return out

    def search(self, text: str, windows: set[tuple[int, int]] | None = None, weights: dict[str, float] | None = None) -> list[tuple]:
        """(item id, first word, words, distance, similarity): each item's best window.

        Where the benchmark has other blocks, ``windows`` are those of all blocks and
        ``weights`` those of all their shingles that recur in the benchmark.
        """
        found = words(text)
        weight = self.weight if weights is None else (lambda x: weights.get(x) or self.weight(x))
        best: dict[int, tuple] = {}
        for s, size in sorted(self.starts(found) if windows is None else windows):
            window = shingles(found[s : s + size])
            bag = Counter(window)
            fp = fingerprint(_hashes(window), np.array([weight(x) for x in window]))
            for k, d in self.within(fp):
                alike = similarity(bag, self.bags[k], weight)
                if alike >= LEAST - 1e-12 and (k not in best or alike > best[k][4]):
                    best[k] = (self.ids[k], s, min(size, len(found) - s), d, alike)
        return [best[k] for k in sorted(best)]


def _codes(n: np.ndarray) -> np.ndarray:
    """A number for each run of WIDTH word numbers."""
    size = len(n) - WIDTH + 1
    out = np.zeros(max(size, 0), np.uint64)
    for k in range(WIDTH if size > 0 else 0):
        out = (out + n[k : k + size]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(i, w): the least id and the words, joined by blanks, of the items; those of equal words are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([" ".join(words(t)) for t in b.column(1).to_pylist()], pa.string())], names=["i", "w"])

    kind = benchmark.schema[id_col].dataType.simpleString()
    given = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    found = given.mapInArrow(tidy(run), f"i {kind}, w string").where("w != ''")
    return found.groupBy("w").agg(F.min("i").alias("i")).select("i", "w")


def _recurring(items: DataFrame) -> DataFrame:
    """(s, k): the shingles of two items or more, and of how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(sorted(set(shingles(t.split(" ")))), pa.string())], names=["s"])

    return items.select("w").mapInArrow(tidy(run), "s string").groupBy("s").agg(F.count("*").alias("k")).where("k > 1")


@dataclass
class _Plan:
    """The merged items, how many there are, and the blocks they are searched in."""

    items: DataFrame
    total: int
    blocks: int
    recur: DataFrame | None = None

    def indexes(self) -> Iterator[Index]:
        for b in range(self.blocks):
            # one block of the stated query set, bounded by MOST_ITEMS and MOST_BYTES on average
            rows = self.items.where(F.pmod(F.xxhash64("w"), F.lit(self.blocks)) == b).orderBy("i", "w").collect()
            if not rows:
                continue
            texts = [r["w"].split(" ") for r in rows]
            # rare shingles weigh more; one in no item weighs as one in a single item
            if self.recur is None:
                df = Counter(s for w in texts for s in set(shingles(w)))
                weights = {s: math.log1p(self.total / k) for s, k in df.items() if k > 1}
            else:
                own = self.items.sparkSession.createDataFrame([(s,) for s in sorted({s for w in texts for s in shingles(w)})], "s string")
                weights = {r["s"]: math.log1p(self.total / r["k"]) for r in self.recur.join(own, "s", "left_semi").collect()}
            yield Index([r["i"] for r in rows], texts, weights, math.log1p(self.total))


def _plan(benchmark: DataFrame, id_col: str, text_col: str) -> _Plan:
    items = keep(_items(benchmark, id_col, text_col), "benchmark-items")
    total, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("w")), F.lit(0))).first()
    blocks = max(1, math.ceil(total / MOST_ITEMS), math.ceil(size / MOST_BYTES))
    return _Plan(items, total, blocks, keep(_recurring(items), "benchmark-shingles") if blocks > 1 else None)


def indexes(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """The benchmark in blocks of bounded size; items of equal words are one, with the least id."""
    return _plan(benchmark, id_col, text_col).indexes()


def _hits(texts: DataFrame, plan: _Plan) -> DataFrame:
    """(key, item, start, n, distance, similarity) of distinct ``texts`` (key, t), over several blocks."""
    spark, spans = texts.sparkSession, "array<struct<p:int,n:int>>"
    pairs = pa.list_(pa.struct([("p", pa.int32()), ("n", pa.int32())]))

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    def asked(index: Index) -> DataFrame:
        shipped = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [[{"p": p, "n": n} for p, n in shipped.value.starts(words(t))] for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pairs)], names=["key", "x"])

        return keep(texts.mapInArrow(tidy(run), f"key string, x {spans}").where("size(x) > 0"), "benchmark-windows")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, t, x in zip(*(c.to_pylist() for c in b.columns)):
                w = words(t)
                found = sorted({s for y in x for s in shingles(w[y["p"] : y["p"] + y["n"]])})
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.string()), pa.array(found, pa.string())], names=["key", "s"])

    def searched(index: Index) -> DataFrame:
        shipped = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shipped.value
            types = [pa.string(), pa.array(index.ids).type, pa.int64(), pa.int64(), pa.int32(), pa.float64()]
            for b in batches:
                rows = []
                for key, t, x, weights in zip(*(c.to_pylist() for c in b.columns)):
                    rows += [(key, *y) for y in index.search(t, {(y["p"], y["n"]) for y in x}, dict(weights or ()))]
                cols = list(zip(*rows)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, types)], names=["key", "item", "start", "n", "distance", "similarity"])

        kind = plan.items.schema["i"].dataType.simpleString()
        return keep(near.mapInArrow(tidy(run), f"key string, item {kind}, start bigint, n bigint, distance int, similarity double"), "benchmark-hits")

    wanted = union([asked(index) for index in plan.indexes()])
    wanted = wanted.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("x"))).alias("x"))
    near = keep(texts.join(wanted, "key").select("key", "t", "x"), "benchmark-near")
    known = near.mapInArrow(tidy(shingled), "key string, s string").join(plan.recur, "s")
    known = known.select("key", F.struct("s", F.log1p(F.lit(plan.total) / F.col("k"))).alias("w")).groupBy("key").agg(F.map_from_entries(F.collect_list("w")).alias("weights"))
    near = keep(near.join(known, "key", "left"), "benchmark-weighed")
    return union([searched(index) for index in plan.indexes()])


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, start_word, n_words, distance, similarity): each document and item it holds.

    Words are runs of letters and digits, lower-cased.  The benchmark is the query
    set: it is taken in blocks of bounded size, each against every document.  Items
    with the same words are reported under their least id.

    Null, empty and wordless texts and items are in no pair.  Very long texts are
    read whole; of windows equally similar the first is reported; repeated rows
    are reported each.  Without items or documents the result is empty.  Other
    columns are ignored.
    """
    spark = docs.sparkSession
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"i {kinds[0]}, item {kinds[1]}, start bigint, n bigint, distance int, similarity double"
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    names = ["i", "item", "start", "n", "distance", "similarity"]

    def searched(index: Index) -> DataFrame:
        shipped = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shipped.value
            types = None
            for b in batches:
                types = types or [b.schema.field(0).type, pa.array(index.ids).type, pa.int64(), pa.int64(), pa.int32(), pa.float64()]
                memo: dict[str, list] = {}
                rows = []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if t not in memo:
                        memo[t] = index.search(t)
                    rows += [(i, *x) for x in memo[t]]
                cols = list(zip(*rows)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, types)], names=names)

        return texts.mapInArrow(tidy(run), schema)

    out, plan = None, _plan(benchmark, item_col, item_text_col)
    if plan.blocks > 1:
        keyed = texts.withColumn("key", F.sha2("t", 256))
        out = keyed.select("i", "key").join(_hits(keyed.select("key", "t").dropDuplicates(["key"]), plan), "key").select(*names)
    else:
        for index in plan.indexes():
            out = searched(index)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.select(F.col("i").alias(id_col), F.col("item").alias(item_col), F.col("start").alias("start_word"), F.col("n").alias("n_words"), "distance", "similarity")


def without_items(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold no item of the benchmark.

    The same search as ``contaminated``; rows pass through, without a shuffle if
    the benchmark is one block.  Null and empty texts stay.
    """
    spark, at = docs.sparkSession, docs.columns.index(text_col)

    def cleaned(docs: DataFrame, index: Index) -> DataFrame:
        shipped = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shipped.value
            for b in batches:
                memo: dict[str | None, bool] = {None: True}
                clean = []
                for t in b.column(at).to_pylist():
                    if t not in memo:
                        memo[t] = not index.search(t)
                    clean.append(memo[t])
                yield b.filter(pa.array(clean, pa.bool_()))

        return docs.mapInArrow(tidy(run), docs.schema)

    plan = _plan(benchmark, item_col, item_text_col)
    if plan.blocks > 1:
        key = F.sha2(F.col(text_col), 256)
        texts = docs.where(F.col(text_col).isNotNull()).select(key.alias("key"), F.col(text_col).alias("t")).dropDuplicates(["key"])
        hits = _hits(texts, plan).select("key").distinct()
        return docs.join(hits, key == hits["key"], "left_anti")
    for index in plan.indexes():
        docs = cleaned(docs, index)
    return docs
