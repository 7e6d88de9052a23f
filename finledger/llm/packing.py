"""Packing by power-of-two decomposition: no sequence crosses documents.

A document's ids (and a closing id) are cut into pieces of binary lengths:
as many of ``longest`` as fit, then one for each set bit of what is left,
long ones first. Every piece is a sequence of its own and has the length of a
power of two, so nothing is padded. Equal lengths share a bucket; within a
bucket sequences are numbered in a seeded shuffled order, so batches of one
length are runs of sequence numbers.

Ids are made in one pass over the texts. Only piece lengths and numbers are shuffled for the
numbering (see :func:`~finledger.llm._common.ranked`), unless the
caller carries the ids along.

Defined cases: a null text is empty and packs to the closing id alone;
repeated rows are packed each; rows of one id with different texts are numbered by a hash of their ids, and pieces that
very many rows share (or a null id of many) by their place in the input; an empty table gives no pieces; other columns are
dropped but for the id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finledger.llm._common import in_pieces, ranked, with_uniform, written

LONGEST = 1024
END_ID = 0
SEED = 29
_SPECIAL = "<|"              # texts with it may hold a special token: they go through the tokenizer whole
PIECES = "start bigint, length bigint, doc_tokens bigint, ids binary"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Encoder:
    """Little-endian unsigned 32-bit ids of whole texts, as the tokenizer of the file makes them.

    In a byte-level BPE file ids rise in the order of the merges, so its vocabulary is a
    table of ranks: tiktoken makes the same ids from it several times as fast. A text that may
    hold a special token's string goes through the tokenizer itself, and so does one that tiktoken
    refuses: its regex gives up (ValueError) on a run of about a million spaces.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"] for x in spec.get("added_tokens", [])}
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.ordinary = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.tokenizer = Tokenizer.from_file(path)

    def __call__(self, text: str) -> bytes:
        import numpy as np

        if _SPECIAL not in text:
            try:
                return self.ordinary.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
            except ValueError:
                pass
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def lengths(n: int, longest: int = LONGEST) -> list[int]:
    """The binary pieces of n tokens."""
    out = [longest] * (n // longest)
    rest, bit = n % longest, longest
    while bit:
        bit >>= 1
        if rest & bit:
            out.append(bit)
    return out


def cut_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None,
               longest: int = LONGEST, end_id: int = END_ID) -> DataFrame:
    """(_id, start, length, doc_tokens, ids): one row for each piece, ids as little-endian unsigned 32-bit integers."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    path = tokenizer or tokenizer_path()

    def run(batches):
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, end = _Encoder(path), end_id.to_bytes(4, "little")
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            # a few MB of text at a time: bounds what a task holds
            for some in in_pieces(range(b.num_rows), lambda i: len(texts[i].as_py() or ""), 4 << 20):
                which, start, length, total, data = [], [], [], [], []
                for i in some:
                    x = encode(texts[i].as_py() or "") + end
                    at, n = 0, len(x) // 4
                    for size in lengths(n, longest):
                        which.append(i)
                        start.append(at)
                        length.append(size)
                        total.append(n)
                        data.append(x[4 * at:4 * (at + size)])
                        at += size
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(which, pa.int32())), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.array(total, pa.int64()), pa.array(data, pa.binary())],
                    ["_id", "start", "length", "doc_tokens", "ids"])

    d = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    return d.mapInArrow(run, f"_id {d.schema['_id'].dataType.simpleString()}, {PIECES}")


def _told_apart(pieces: DataFrame) -> DataFrame:
    """Adds _tie, a hash of the ids, for pieces of one document id, and _i, a number of its own for each piece."""
    return pieces.withColumns({"_tie": F.xxhash64("ids"), "_i": F.monotonically_increasing_id()})


def number_sequences(pieces: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds sequence_id (gapless over all pieces, equal lengths together, longest last) and offset (0) to written pieces.

    Columns used: _id, start, length, _tie and _i (:func:`_told_apart`); any others travel along.
    """
    n = pieces.count()
    rows = with_uniform(pieces, n, seed, ["_id", "start", "_tie"], "_i")
    rows = ranked(rows, n, ["length"], F.col("_u"), ["_u", "_id", "start", "_tie", "_i"], "_rank").drop("_u", "_tie", "_i")
    by = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("_n"))  # one row for each power of two
    sums = by.alias("x").join(by.alias("y"), F.col("y.length") < F.col("x.length"), "left")
    before = sums.groupBy(F.col("x.length").alias("_len")).agg(F.coalesce(F.sum("y._n"), F.lit(0)).alias("_before"))
    before = written(before, "pack-buckets")
    j = rows.join(before, F.col("length") == F.col("_len"))
    return j.withColumns({"sequence_id": F.col("_before") + F.col("_rank") - 1, "offset": F.lit(0).cast("long")}).drop("_rank", "_len", "_before")


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None,
         longest: int = LONGEST, end_id: int = END_ID, seed: int = SEED) -> DataFrame:
    """All sequences with their ids: (id, start, length, doc_tokens, ids, sequence_id, offset)."""
    pieces = written(_told_apart(cut_pieces(docs, doc_id, text, tokenizer, longest, end_id)), "pieces")
    return number_sequences(pieces, seed).withColumnRenamed("_id", doc_id)


def pack_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """As :func:`pack` with ids_crc32 for the ids, which are never shuffled or stored."""
    seed = options.pop("seed", SEED)
    cut = cut_pieces(docs, doc_id, text, **options)
    pieces = written(_told_apart(cut).withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return number_sequences(pieces, seed).withColumnRenamed("_id", doc_id)
