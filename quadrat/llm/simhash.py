"""SimHash near-duplicates by segment-popcount embedding.

A fingerprint is mapped to its bit counts in ``SEGMENTS`` segments.  Two
fingerprints that differ in d bits have embeddings at Manhattan distance at most
d.  The axes are dealt into ``GROUPS`` groups; a distance of at most ``RADIUS``
moves a point along at most ``RADIUS`` groups, so two near points share a cell of
the grid on some ``GROUPS - RADIUS`` of the groups.  The range join is the join on
those cells; the Manhattan distance bounds from below, the bits decide.

A cell of more than ``MOST`` fingerprints is not paired.  Its fingerprints are
linked over midpoints instead: two fingerprints at distance 2 or less share a
64-bit value at distance 1 or less from both, and all that share one are linked.
That is exact, and a midpoint has 65 fingerprints at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import keep, tidy
from quadrat.llm.components import components

SEGMENTS, WIDTH, GROUPS, RADIUS, MOST = 32, 2, 5, 2, 16
SEED = 42
_BITS = np.array([[v >> k & 1 for k in range(8)] for v in range(256)], np.int32)


def words(text: str) -> list[bytes]:
    """The words in UTF-8; of bytes only A-Z are lowered, and only the six blanks of ASCII separate."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str, width: int = 3) -> list[bytes]:
    """Runs of ``width`` words joined by spaces; fewer words give one run, none give none."""
    found = words(text)
    if len(found) <= width:
        return [b" ".join(found)] if found else []
    return list(map(b" ".join, zip(*(found[k : len(found) - width + 1 + k] for k in range(width)))))


def majority(h: np.ndarray) -> int:
    """64 bits; a bit is 1 if it is set in over half of the hashes (uint64)."""
    if not len(h):
        return 0
    octets = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)
    if len(h) < 200:
        counts = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, width: int = 3) -> int:
    """64 bits; a bit is 1 if it is set in over half of the shingles' XXH64."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(s, SEED) for s in shingles(text, width)], np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp long) of every row; each distinct text of a batch is hashed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            memo: dict[str, int] = {}
            out = []
            for t in b.column(1).to_pylist():
                t = t or ""
                if t not in memo:
                    memo[t] = fingerprint(t, width)
                out.append(memo[t])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], names=["i", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(tidy(run), f"i {kind}, fp bigint").select(F.col("i").alias(id_col), "fp")


def _count(fp: Column, segment: int) -> Column:
    return F.bit_count(F.shiftrightunsigned(fp, segment * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1)))


def _axis_groups() -> list[list[int]]:
    return [list(range(SEGMENTS))[k::GROUPS] for k in range(GROUPS)]


def cells(fp: Column) -> Column:
    """Array of grid cells (longs), one for each choice of ``GROUPS - RADIUS`` axis groups."""
    base = WIDTH + 1
    groups = _axis_groups()
    part = [sum((_count(fp, s).cast("long") * base**n for n, s in enumerate(g)), F.lit(0).cast("long")) for g in groups]
    keys = []
    for choice, picked in enumerate(combinations(range(GROUPS), GROUPS - RADIUS)):
        key, scale = F.lit(0).cast("long"), 1
        for g in picked:
            key += part[g] * scale
            scale *= base ** len(groups[g])
        keys.append(key * 16 + choice)
    return F.array(*keys)


def manhattan(a: Column, b: Column) -> Column:
    return sum((F.abs(_count(a, s) - _count(b, s)) for s in range(SEGMENTS)), F.lit(0))


def links(unique: DataFrame) -> DataFrame:
    """(a, b): edges between distinct fingerprints ``fp`` of ``unique`` that join all within ``RADIUS`` bits.

    Every edge is a pair within ``RADIUS``; pairs of crowded cells may be joined by
    way of others, so components are exact while edges stay linear in the input.
    """
    placed = unique.select("fp", F.explode(cells(F.col("fp"))).alias("cell"))
    # sizes are partial sums; only then are small cells gathered, each of MOST at most
    sizes = keep(placed.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), "cells")
    met = keep(placed.join(sizes, "cell"), "cells-met")
    small = met.where(F.col("n") <= MOST).groupBy("cell").agg(F.sort_array(F.collect_list("fp")).alias("m"))
    pair = F.flatten(
        F.transform(
            "m",
            lambda a: F.transform(
                F.filter("m", lambda b: (a < b) & (manhattan(a, b) <= RADIUS) & (F.bit_count(a.bitwiseXOR(b)) <= RADIUS)),
                lambda b: F.struct(a.alias("a"), b.alias("b")),
            ),
        )
    )
    near = small.select(F.explode(pair).alias("p")).select("p.a", "p.b")
    crowded = met.where(F.col("n") > MOST).select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << k) - (1 << 64) * (k == 63))) for k in range(64)])
    around = crowded.select("fp", F.explode(flips).alias("mid"))
    first = around.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    over = around.join(first, "mid").select("a", F.col("fp").alias("b")).where("a != b")
    return near.unionByName(over).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fingerprint, component_id) of every row.

    ``fingerprint`` is 16 hexadecimal digits; ``component_id`` the smallest id
    reachable over fingerprints that differ in 2 bits or fewer.

    Equal fingerprints are one node whatever their number of rows, so groups of
    copies cost nothing.  Null, empty and blank texts have fingerprint zero and
    link like any other.  Very long texts are hashed whole.  Repeated rows are
    kept one to one; a null id is never a component's id unless all are null.  An
    empty table gives an empty result; other columns are ignored.
    """
    rows = keep(fingerprints(docs, id_col, text_col, width), "fingerprints")
    unique = keep(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "fingerprints-unique")
    found = components(links(unique))
    rooted = unique.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = keep(rooted, "fingerprints-rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = keep(rooted.join(keep(least, "components-least"), "root").select("fp", "component_id"), "components-named")
    return rows.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
