"""Token counts: lengths only, encoded in Arrow batches balanced by bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import tidy

#: A blank between two plain letters or digits, where a long text may be cut.
_CUT = re.compile(r"(?<=[A-Za-z0-9])\x20(?=[A-Za-z0-9])")
_LOADED: dict = {}


class Counter:
    """Counts of one vocabulary, built from the bytes of its file."""

    def __init__(self, name: str, data: bytes):
        if name.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=data)
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            pieces = (model.id_to_piece(i) for i in range(model.vocab_size()))
            blank = "▁"
            joined = any(blank in p.lstrip(blank) for p in pieces)
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_str(data.decode("utf-8"))
            model.no_truncation()
            model.no_padding()
            self.encode = lambda texts: [
                len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)
            ]
            joined = True
        # A cut is safe where no token spans it and the blank is the dummy prefix
        # of what follows; otherwise texts stay whole.
        whole, parts = self.encode(["ab 9c d"])[0], sum(self.encode(["ab", "9c", "d"]))
        self.safe = not joined and whole == parts

    def pieces(self, text: str, size: int) -> list[str]:
        if not self.safe or len(text) <= size:
            return [text]
        out, at = [], 0
        while len(text) - at > size and (m := _CUT.search(text, at + size)):
            out.append(text[at : m.start()])
            at = m.end()
        return [*out, text[at:]]


def _counter(name: str, data: bytes) -> Counter:
    key = (name, len(data), hash(data))
    if key not in _LOADED:
        _LOADED[key] = Counter(name, data)
    return _LOADED[key]


def count_texts(counter: Counter, texts: list[str], batch_bytes: int, piece_chars: int) -> list[int]:
    """Counts of ``texts``; each distinct text of the batch is encoded once."""
    slot = {t: k for k, t in enumerate(dict.fromkeys(texts))}
    totals = [0] * len(slot)
    batch: list[str] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        for k, n in zip(owners, counter.encode(batch)) if batch else ():
            totals[k] += n
        batch.clear(), owners.clear()
        held = 0

    for text, k in slot.items():
        for piece in counter.pieces(text, piece_chars):
            batch.append(piece)
            owners.append(k)
            held += len(piece)
            if held >= batch_bytes:
                flush()
    flush()
    return [totals[slot[t]] for t in texts]


def token_counts(
    docs: DataFrame,
    model_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 4096,
    batch_bytes: int = 1 << 20,
    piece_chars: int = 1 << 16,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row of ``docs``.

    The vocabulary's bytes travel with the tasks (a file of fixed size), so
    executors need no file of their own.  Special strings inside texts follow the
    library's default; nothing is truncated, padded or added.

    Null and empty texts have 0 bytes and 0 tokens.  Texts beyond ``piece_chars``
    are cut only where no token can span the cut, so counts stay those of the
    whole text.  Null ids and repeated rows are kept one to one; an empty table
    gives an empty result; other columns are ignored.
    """
    with open(model_path, "rb") as f:
        data = f.read()
    name = model_path.rsplit("/", 1)[-1]
    shipped = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(name, shipped.value)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = count_texts(counter, texts, batch_bytes, piece_chars)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n, pa.int64())], names=["i", "b", "n"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("i"), text.alias("t"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("b")
    ).mapInArrow(tidy(run), f"i {kind}, b bigint, n bigint")
    return rows.select(
        F.col("i").alias(id_col),
        F.col("b").alias("n_bytes"),
        F.col("n").alias("n_tokens"),
        (F.col("n") > limit).alias("over_limit"),
    )
