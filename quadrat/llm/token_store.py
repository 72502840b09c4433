"""Content-addressed store of token ids.

Layout below the store's path, all written by Spark's committed writers:

``first/kind=chunk``   one row per distinct chunk: key (BLAKE2b-128 of the ids as
                       little-endian uint32) and payload (zstd frame of the ids)
``first/kind=recipe``  one row per document: what the encoding gave, any order
``recipes/kind=recipe``    the documents in ascending id, in parts; each row lists the
                       chunk keys and lengths, its place in the part and its Merkle root
``recipes/kind=manifest``  one row per part: documents, ids, Merkle root over the documents
``about``                  the type of the documents' ids
``root``                   one row: how many parts there are, Merkle root over their roots

A rolling hash over the last ids decides where an id stream is cut, so equal
passages give equal chunks wherever they stand.  Texts are encoded once.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from array import array
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm.common import by_bytes, tidy

#: Ids that the rolling hash covers (a power of two), bounds and mean of a chunk's length.
WINDOW, LEAST, MOST, MEAN = 8, 128, 4096, 512
KEY = 16
#: Documents in a part, about.
MOST_DOCS = 500_000

#: Characters that Unicode's versions agree on; a text with others is given to the
#: library whole, and so is one with two blanks in a row, where a split of the text
#: depends on what follows.
_UNSAFE = r"[^\t\n\r\x20-\x7e\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ȳΑ-ΡΣ-ωА-я‐-‧€\xa1-\xa9\xab\xac\xae-\xb1\xb4\xb6-\xb8\xbb\xbf]|\s\s"
#: Marks that make a piece of their own after letters, alone or in a run.
_ENDS = ".,;:!?#$%&*|/\\)(\"+=<>-"
_LOADED: dict = {}


class Encoder:
    """Ids of whole texts; a word already met is not encoded again.

    Byte-level vocabularies split a text before any merge, among other places
    in front of every single space or line feed, so the ids of a text are those of
    its pieces in order, each piece with the blank in front of it.  Marks after
    letters are split off as well.  Whatever might be split otherwise goes to the
    library as a whole text: odd characters, blanks in a row, special strings, and
    all texts of other vocabularies.

    Pieces met before and their ids are two Arrow arrays of at most ``most_words``
    and one batch's pieces; beyond that those stay that the last batch used.
    """

    def __init__(self, data: str, most_words: int = 500_000):
        import json

        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(data)
        self.model.no_truncation()
        self.model.no_padding()
        spec = json.loads(data)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self.by_word = norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.most_words = most_words
        self.known = pa.array([], pa.large_string())
        self.ids = pa.array([], pa.large_binary())
        self.marks: dict[str, bytes] = {}
        self.swap = _byte_letters()
        self.feed = self.whole(["\n"])[0]

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def odd(self, texts: pa.Array) -> np.ndarray:
        """Which texts must be given to the library whole."""
        import pyarrow.compute as pc

        out = pc.match_substring_regex(texts, _UNSAFE)
        for s in self.special:
            out = pc.or_(out, pc.match_substring(texts, s))
        return out.to_numpy(zero_copy_only=False)

    def spell(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words given in the vocabulary's byte letters: each is one word to the merges."""
        number = attrgetter("id")
        for tokens in map(self.model.model.tokenize, words):
            yield array("I", map(number, tokens)).tobytes()

    def letters(self, words: list[str]) -> list[str]:
        """The byte letters of words."""
        swap = self.swap
        return [w if w.isascii() else w.encode().decode("latin-1").translate(swap) for w in words]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of pieces given without the space in front (NUL starts a text), and of their stems."""
        import pyarrow.compute as pc

        plain = list(filter(str.isalpha, new))
        found = dict(zip(plain, self.spell(["\u0120" + w for w in self.letters(plain)])))
        rest = [p for p in new if p not in found]
        # marks after letters, or a line feed before them, are split off
        ends = [(p, b, p[len(b) :]) for p in rest if (b := p.rstrip(_ENDS)) != p and b.isalpha()]
        runs = {m for _, _, m in ends}.difference(self.marks)
        if runs:
            if len(self.marks) > 20_000:
                self.marks, runs = {}, {m for _, _, m in ends}
            self.marks.update(zip(runs, self.whole(list(runs))))
        stems = list({b for _, b, _ in ends}.difference(found))
        at = pc.index_in(pa.array(stems, pa.large_string()), value_set=self.known)
        met = dict(zip(stems, self.ids.take(at).to_pylist()))
        fresh = [b for b, ids in met.items() if ids is None]
        found.update(zip(fresh, self.spell(["\u0120" + w for w in self.letters(fresh)])))
        found.update([(p, (found.get(b) or met[b]) + self.marks[m]) for p, b, m in ends])
        feeds = [p for p in rest if p[:1] == "\n" and p[1:].isalpha()]
        found.update(zip(feeds, map(self.feed.__add__, self.spell(self.letters([p[1:] for p in feeds])))))
        odd = [p for p in rest if p not in found]
        for k in range(0, len(odd), 20_000):
            some = odd[k : k + 20_000]
            bare = [p if p[:1] == "\n" else p[1:] if p[:1] == "\0" else " " + p for p in some]
            found.update(zip(some, self.whole(bare)))
        return found

    def _places(self, pieces: pa.Array) -> pa.Array:
        """Where each of some distinct pieces stands in ``known``; new ones are learnt."""
        import pyarrow.compute as pc

        at = pc.index_in(pieces, value_set=self.known)
        if not at.null_count:
            return at
        found = self._learn(pieces.filter(at.is_null()).to_numpy(zero_copy_only=False).tolist())
        if len(self.known) + len(found) > self.most_words:
            used = at.drop_null()
            self.known, self.ids = self.known.take(used), self.ids.take(used)
        self.known = pa.concat_arrays([self.known, pa.array(found.keys(), pa.large_string())])
        self.ids = pa.concat_arrays([self.ids, pa.array(found.values(), pa.large_binary())])
        return pc.index_in(pieces, value_set=self.known)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian uint32.

        The pieces of all texts are numbered at once; only distinct pieces are
        looked up, and their ids are put in order by gathering.
        """
        import pyarrow.compute as pc

        if not self.by_word:
            return self.whole(texts)
        given = pa.array(texts, pa.large_string())
        odd = self.odd(given)
        out: list = [None] * len(texts)
        rest = np.flatnonzero(odd).tolist()
        for k, ids in zip(rest, self.whole([texts[k] for k in rest])):
            out[k] = ids
        plain = np.flatnonzero(~odd)
        if not len(plain):
            return out
        marked = pa.array(["\0" + texts[k].replace("\n", " \n") for k in plain.tolist()], pa.large_string())
        cut = pc.split_pattern(marked, " ")
        numbered = cut.flatten().dictionary_encode()
        places = self._places(numbered.dictionary).take(numbered.indices)
        ids = self.ids.take(places)
        _, bounds, stream = ids.buffers()
        first = np.frombuffer(bounds, np.int64)[ids.offset :][cut.offsets.to_numpy()].tolist()
        for k, a, z in zip(plain.tolist(), first, first[1:]):
            out[k] = stream[a:z].to_pybytes()
        return out


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: the printable
    ones for themselves, the others in order from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(others)}


def _encoder(data: str) -> Encoder:
    key = hash(data)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoder(data)
    return _LOADED[key]


def _mixed(ids: np.ndarray) -> np.ndarray:
    """A 32-bit scramble of each id."""
    x = ids.astype(np.uint32) * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    return x ^ (x >> np.uint32(13))


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    # the sum over the last WINDOW ids, each shifted by its distance, in doubling steps
    rolled, k = _mixed(ids), 1
    while k < WINDOW:
        rolled[k:] += rolled[:-k] << np.uint32(k)
        k *= 2
    marks = np.flatnonzero((rolled >> np.uint32(8)) % np.uint32(MEAN - LEAST) == 0) + 1
    ends, at = [], 0
    for m in marks.tolist():
        while m - at > MOST:
            at += MOST
            ends.append(at)
        if m - at >= LEAST:
            at = m
            ends.append(at)
    while n - at > MOST:
        at += MOST
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=KEY).digest()


class Merkle:
    """Root of a binary hash tree over leaves given one by one, in log memory."""

    def __init__(self) -> None:
        self.peaks: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        node = (0, digest(b"\0" + leaf))
        while self.peaks and self.peaks[-1][0] == node[0]:
            node = (node[0] + 1, digest(b"\1" + self.peaks.pop()[1] + node[1]))
        self.peaks.append(node)

    def root(self) -> bytes:
        if not self.peaks:
            return digest(b"\2")
        out = self.peaks[-1][1]
        for _, p in reversed(self.peaks[:-1]):
            out = digest(b"\1" + p + out)
        return out


def merkle_root(leaves: list[bytes]) -> bytes:
    tree = Merkle()
    for x in leaves:
        tree.add(x)
    return tree.root()


# crc32 of a joined stream: crc(A + B) = crc(A) * x^(8 |B|) ^ crc(B) over GF(2), so a
# document's crc is the exclusive or of its chunks' crcs, each shifted by what follows.
_POLY = np.uint64(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of reflected polynomials modulo the CRC-32 polynomial."""
    out = np.zeros_like(a)
    a, b, one = a.copy(), b.copy(), np.uint64(1)
    for _ in range(32):
        out ^= np.where(a & np.uint64(1 << 31), b, np.uint64(0))
        a = (a << one) & np.uint64(0xFFFFFFFF)
        b = (b >> one) ^ np.where(b & one, _POLY, np.uint64(0))
    return out


def _powers() -> list[np.uint64]:
    p = np.array([1 << 30], np.uint64)  # x
    out = []
    for _ in range(40):
        out.append(p[0])
        p = _times(p, p)
    return out


def shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """``crc`` times x^(8 n_bytes), elementwise."""
    bits, out = n_bytes.astype(np.uint64) * np.uint64(8), crc.astype(np.uint64)
    for k, p in enumerate(_powers()):
        hit = (bits >> np.uint64(k)) & np.uint64(1) == 1
        if hit.any():
            out[hit] = _times(out[hit], np.full(int(hit.sum()), p))
    return out


class TokenStore:
    """A store at ``path``; ``write`` fills it, the other methods read its files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, docs: DataFrame, vocabulary: str, *, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> TokenStore:
        """Encode and store every row of ``docs``.

        Null texts count as empty; a document of no text holds the end id alone
        (no chunk at all if ``end_id`` is None).  Null ids come first, repeated
        rows are stored as documents of their own with shared chunks.  Very long
        texts are encoded whole.  An empty table gives an empty store.  Other
        columns are ignored.
        """
        with open(vocabulary, encoding="utf-8") as f:
            data = f.read()
        shipped = self.spark.sparkContext.broadcast(data)
        end = b"" if end_id is None else struct.pack("<I", end_id)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import zstandard
            from pyspark import TaskContext

            encoder, pack = _encoder(shipped.value), zstandard.ZstdCompressor(level=1).compress
            part, n_rows, seen = TaskContext.get().partitionId(), 0, set()
            for b in batches:
                for some in by_bytes(b, 1, 6 << 20):
                    rows: list = []
                    memo: dict[str, tuple[bytes, int]] = {}
                    texts = [t or "" for t in some.column(1).to_pylist()]
                    distinct = list(dict.fromkeys(texts))
                    for text, raw in zip(distinct, encoder.encode(distinct)):
                        raw += end
                        ids, recipe, a = np.frombuffer(raw, "<u4"), [], 0
                        small = ids.astype("<u2") if not len(ids) or int(ids.max()) < 1 << 16 else None
                        for z in cut_points(ids):
                            key = digest(raw[4 * a : 4 * z])
                            recipe.append(key + struct.pack("<I", z - a))
                            if key not in seen:
                                seen.add(key)
                                body = b"2" + small[a:z].tobytes() if small is not None else b"4" + raw[4 * a : 4 * z]
                                rows.append(("chunk", key, None, z - a, pack(body)))
                            a = z
                        memo[text] = b"".join(recipe), len(ids)
                    for i, text in zip(some.column(0).to_pylist(), texts):
                        recipe, n = memo[text]
                        rows.append(("recipe", struct.pack(">IQ", part, n_rows), i, n, recipe))
                        n_rows += 1
                    cols = list(zip(*rows)) if rows else [[]] * 5
                    types = (pa.string(), pa.binary(), b.schema.field(0).type, pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=["kind", "key", "i", "n", "payload"])

        kind = docs.schema[id_col].dataType.simpleString()
        self.spark.createDataFrame([(kind,)], "id_type string").coalesce(1).write.parquet(f"{self.path}/about")
        rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(tidy(run), f"kind string, key binary, i {kind}, n bigint, payload binary")
        once = rows.groupBy("kind", "key").agg(F.first("i").alias("i"), F.first("n").alias("n"), F.first("payload").alias("payload"))
        once.write.partitionBy("kind").option("compression", "uncompressed").parquet(f"{self.path}/first")
        self._sort_recipes(kind)
        return self

    def _sort_recipes(self, kind: str) -> None:
        first = self._read("first", "recipe", f"key binary, i {kind}, n bigint, payload binary")
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(first.count() / MOST_DOCS))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part, at, n_docs, tree = TaskContext.get().partitionId(), 0, 0, Merkle()
            names = ["kind", "part", "pos", "rel", "i", "n", "payload", "root"]
            for b in batches:
                roots, rel = [], []
                for n, payload in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                    root = merkle_root([payload[k : k + KEY + 4] for k in range(0, len(payload), KEY + 4)])
                    tree.add(root)
                    roots.append(root)
                    rel.append(at)
                    at += n
                m = b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(["recipe"] * m), pa.array([part] * m, pa.int32()), pa.array(range(n_docs, n_docs + m), pa.int64()), pa.array(rel, pa.int64()), b.column(1), b.column(2), b.column(3), pa.array(roots, pa.binary())], names=names)
                n_docs += m
            if n_docs:
                i_type = b.schema.field(1).type
                yield pa.RecordBatch.from_arrays([pa.array(["manifest"]), pa.array([part], pa.int32()), pa.array([n_docs], pa.int64()), pa.array([0], pa.int64()), pa.nulls(1, i_type), pa.array([at], pa.int64()), pa.array([b""], pa.binary()), pa.array([tree.root()], pa.binary())], names=names)

        ranged = first.repartitionByRange(parts, "i", "key").sortWithinPartitions("i", "key")
        rows = ranged.mapInArrow(tidy(run), f"kind string, part int, pos bigint, rel bigint, i {kind}, n bigint, payload binary, root binary")
        rows.write.partitionBy("kind").parquet(f"{self.path}/recipes")
        found = self.manifest().orderBy("part").collect()  # a row per part
        top = [(len(found), bytearray(merkle_root([bytes(r["root"]) for r in found])))]
        self.spark.createDataFrame(top, "parts bigint, root binary").coalesce(1).write.parquet(f"{self.path}/root")

    def _read(self, folder: str, kind: str, schema: str) -> DataFrame:
        """A kind's rows; none were written if its folder is missing."""
        full = f"{schema}, kind string"
        return self.spark.read.schema(full).parquet(f"{self.path}/{folder}").where(F.col("kind") == kind).drop("kind")

    def _id_type(self) -> str:
        return self.spark.read.schema("id_type string").parquet(f"{self.path}/about").first()[0]

    def recipes(self) -> DataFrame:
        """(part, pos, rel, i, n, payload, root) of every document."""
        schema = f"part int, pos bigint, rel bigint, i {self._id_type()}, n bigint, payload binary, root binary"
        return self._read("recipes", "recipe", schema)

    def manifest(self) -> DataFrame:
        """(part, n_docs, n_ids, root), one row per part."""
        kind = self._id_type()
        schema = f"part int, pos bigint, rel bigint, i {kind}, n bigint, payload binary, root binary"
        return self._read("recipes", "manifest", schema).select("part", F.col("pos").alias("n_docs"), F.col("n").alias("n_ids"), "root")

    def chunks(self, with_ids: bool = False) -> DataFrame:
        """(key, n, crc[, ids]) of every stored chunk, decoded; raises if one is not what its key says."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import zstandard

            unpack = zstandard.ZstdDecompressor().decompress
            for b in batches:
                ns, crcs, ids = [], [], []
                for key, frame in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    body = unpack(frame)
                    raw = body[1:] if body[:1] == b"4" else np.frombuffer(body, "<u2", offset=1).astype("<u4").tobytes()
                    if digest(raw) != key:
                        raise ValueError("a chunk does not match its key")
                    ns.append(len(raw) // 4)
                    crcs.append(zlib.crc32(raw))
                    if with_ids:
                        ids.append(np.frombuffer(raw, "<u4").astype(np.int32))
                cols = [b.column(0), pa.array(ns, pa.int64()), pa.array(crcs, pa.int64())]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=["key", "n", "crc", "ids"][: len(cols)])

        found = self._read("first", "chunk", f"key binary, i {self._id_type()}, n bigint, payload binary")
        return found.select("key", "payload").mapInArrow(tidy(run), "key binary, n bigint, crc bigint" + ", ids array<int>" * with_ids)

    def _uses(self, recipes: DataFrame) -> DataFrame:
        """(part, pos, k, key, said, after): the chunks of each document, with the ids that follow them.

        Raises on a recipe whose hash tree has another root than its chunk list.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                part, pos, ks, keys, ns, after = [], [], [], [], [], []
                for p, q, payload, root in zip(*(b.column(c).to_pylist() for c in ("part", "pos", "payload", "root"))):
                    if merkle_root([payload[k : k + KEY + 4] for k in range(0, len(payload), KEY + 4)]) != root:
                        raise ValueError("a recipe does not match its hash tree")
                    found = [(payload[k : k + KEY], int.from_bytes(payload[k + KEY : k + KEY + 4], "little")) for k in range(0, len(payload), KEY + 4)]
                    left = sum(n for _, n in found)
                    for k, (key, n) in enumerate(found):
                        left -= n
                        part.append(p), pos.append(q), ks.append(k), keys.append(key), ns.append(n), after.append(left)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(pos, pa.int64()), pa.array(ks, pa.int32()), pa.array(keys, pa.binary()), pa.array(ns, pa.int64()), pa.array(after, pa.int64())], names=["part", "pos", "k", "key", "said", "after"])

        return recipes.select("part", "pos", "payload", "root").mapInArrow(tidy(run), "part int, pos bigint, k int, key binary, said bigint, after bigint")

    def digests(self, id_col: str = "doc_id") -> DataFrame:
        """(id, start, n_tokens, ids_crc32, n_chunks) of every document, from the files.

        The parts are held against the manifest first, see ``verify``.  Every chunk
        is read, decoded and checked once; only its length and crc meet the recipes,
        so no ids are shuffled.  A chunk that many documents share makes a skewed
        join, which adaptive execution splits.  Raises on what is damaged or missing.
        """
        recipes = self.recipes()
        # one number per part
        at, starts = 0, []
        for r in self.verify():
            starts.append((r["part"], at))
            at += r["n_ids"]
        offsets = self.spark.createDataFrame(starts, "part int, offset bigint")

        def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                crc, after = (np.asarray(b.column(c).to_numpy(zero_copy_only=False), np.uint64) for c in ("crc", "after"))
                if b.column("n").to_pylist() != b.column("said").to_pylist():
                    raise ValueError("a chunk is not as long as its recipe says")
                yield pa.RecordBatch.from_arrays([b.column("part"), b.column("pos"), b.column("n"), pa.array(shift(crc, after * np.uint64(4)).astype(np.int64))], names=["part", "pos", "n", "crc"])

        met = self._uses(recipes).join(self.chunks(), "key", "left").select("part", "pos", F.coalesce("n", F.lit(-1)).alias("n"), "said", "after", F.coalesce("crc", F.lit(0)).alias("crc"))
        sums = met.mapInArrow(tidy(shifted), "part int, pos bigint, n bigint, crc bigint").groupBy("part", "pos").agg(F.sum("n").alias("n"), F.bit_xor("crc").alias("crc"), F.count("*").alias("k"))
        rows = recipes.select("part", "pos", "rel", "i").join(F.broadcast(offsets), "part").join(sums, ["part", "pos"], "left")
        return rows.select(
            F.col("i").alias(id_col),
            (F.col("offset") + F.col("rel")).alias("start"),
            F.coalesce("n", F.lit(0)).alias("n_tokens"),
            F.coalesce("crc", F.lit(0)).alias("ids_crc32"),
            F.coalesce("k", F.lit(0)).alias("n_chunks"),
        )

    def read(self, id_col: str = "doc_id") -> DataFrame:
        """(id, ids): every document put together again from its chunks.

        Raises on what is damaged or missing, as ``digests`` does.
        """
        self.verify()
        recipes = self.recipes()
        met = self._uses(recipes).join(self.chunks(with_ids=True), "key", "left")
        fine = F.col("ids").isNotNull() & (F.size("ids") == F.col("said"))
        met = met.withColumn("ids", F.when(fine, F.col("ids")).otherwise(F.raise_error(F.lit("a chunk is not as long as its recipe says"))))
        whole = met.groupBy("part", "pos").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
        return recipes.select("part", "pos", "i").join(whole, ["part", "pos"], "left").select(F.col("i").alias(id_col), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))

    def verify(self) -> list:
        """The manifest in order of parts; raises unless it and all recipes are as they were written.

        The root of each part is computed again from its documents in order, in a
        stream; the number of parts and the root over them are those written last.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, n, ids, tree = None, 0, 0, Merkle()
            rows: list[tuple] = []
            for b in batches:
                for p, pos, m, root in zip(*(c.to_pylist() for c in b.columns)):
                    if p != part:
                        rows += [(part, n, ids, tree.root())] * (part is not None)
                        part, n, ids, tree = p, 0, 0, Merkle()
                    tree.add(root if pos == n else b"")
                    n, ids = n + 1, ids + m
            rows += [(part, n, ids, tree.root())] * (part is not None)
            cols = list(zip(*rows)) if rows else [[]] * 4
            types = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=["part", "n_docs", "n_ids", "root"])

        said = self.manifest().orderBy("part").collect()  # a row per part
        ordered = self.recipes().select("part", "pos", "n", "root").repartition(max(1, len(said)), "part").sortWithinPartitions("part", "pos")
        found = ordered.mapInArrow(tidy(run), "part int, n_docs bigint, n_ids bigint, root binary").orderBy("part").collect()
        top = self.spark.read.schema("parts bigint, root binary").parquet(f"{self.path}/root").collect()
        if len(top) != 1 or top[0]["parts"] != len(said) or bytes(top[0]["root"]) != merkle_root([bytes(r["root"]) for r in said]):
            raise ValueError("the manifest is not the one that was written")
        if list(map(tuple, found)) != list(map(tuple, said)):
            raise ValueError("a part does not match the manifest")
        return said
