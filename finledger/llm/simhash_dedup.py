"""SimHash near-duplicates: segment-popcount embedding and a grid range join.

Fingerprint: XXH64 (seed 42) of every ``shingle``-word shingle, a bit is 1 if
it is set in over half of the hashes. Only distinct fingerprints are joined,
so a group of exact copies costs one row.

Embedding: the 64 bits are cut into 32 two-bit segments and each is mapped to
its bit count (0, 1, 2). Manhattan distance between two embeddings never
exceeds the Hamming distance of the fingerprints. Counts are kept in unary (00,
01, 11), so the Manhattan distance is the popcount of an XOR.

Grid range join: the segments form m = (max_bits + 2) // 2 bands. If two
fingerprints differ in at most ``max_bits`` bits, the distances of the bands
sum to at most that, so one band is at distance 0 or 1. Unit grid cells of
each band are joined in range 1: every point has a home row for its cell and
probes its cell and, if its band count is even, the adjacent cells (at
distance exactly 1 one of the two counts is even). The join keeps a pair only
if the whole Manhattan distance (the lower bound) is at most ``max_bits``, and
then verifies the Hamming distance of the fingerprints. Nothing is lost and
no row is broadcast by hint. Rows grow linearly: 2 home and about 26 probe
rows for a fingerprint at 3 bits.

Components come from :mod:`finledger.llm.components`.

Defined cases: a null or empty text has fingerprint zero and links like any
other; fewer than ``shingle`` words: the whole sequence is one shingle; rows
with a null id take part, a component's id is its smallest non-null id (null
if it has none); repeated rows are equal points; an empty table gives an empty
result; other columns, whatever their names, pass through :func:`deduplicate`.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finledger.llm._common import LOWER_BYTES, id_key, seal, text_tie, unseal, written
from finledger.llm.components import components

SHINGLE = 3
MAX_BITS = 3
_LOW = 0x5555555555555555
_ROWS = 1 << 15   # shingles whose bits are summed at once


def _fingerprint(text: str | None, shingle: int) -> int:
    import numpy as np
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    if not w:
        return 0
    if len(w) < shingle:
        parts = [b" ".join(w)]
    else:
        parts = map(b" ".join, zip(*[w[i:] for i in range(shingle)]))
    h = np.fromiter(map(partial(xxh64_intdigest, seed=42), parts), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), _ROWS):
        ones += np.unpackbits(h[i:i + _ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(_id, _tie, fp): one row for each input row; no shuffle."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            fps = [_fingerprint(t.as_py(), shingle) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["_id", "_tie", "fp"])

    d = docs.select(F.col(doc_id).alias("_id"), text_tie(F.coalesce(F.col(text), F.lit(""))).alias("_tie"), F.col(text).alias("_text"))
    kind = d.schema["_id"].dataType.simpleString()
    return d.mapInArrow(run, f"_id {kind}, _tie bigint, fp bigint")


def embedding(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, each in unary within its two bits."""
    low, high = fp.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_LOW))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseOR(high))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def bands(max_bits: int) -> list[int]:
    """Bit masks of the bands, whole segments each."""
    m = (max_bits + 2) // 2
    cuts = [32 * i // m * 2 for i in range(m + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:])]


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Distinct fingerprints (fp) -> pairs (a, b), each once, at most ``max_bits`` apart."""
    if not 0 <= max_bits <= 15:
        raise ValueError("max_bits must be between 0 and 15")
    e = fps.select("fp", embedding(F.col("fp")).alias("e"))
    homes, probes = [], []
    for i, mask in enumerate(bands(max_bits)):
        cell = F.col("e").bitwiseAND(F.lit(_signed(mask)))
        flips = [1 << s for s in range(64) if mask >> s & 1]
        steps = []
        for f in flips:
            c, low_bit = F.lit(_signed(f)), bool(f & _LOW)
            mate = F.lit(_signed(f << 1 if low_bit else f >> 1))
            # unary counts: the low bit may change while the high one is 0, the high one while the low one is 1
            ok = cell.bitwiseAND(mate) == 0 if low_bit else cell.bitwiseAND(mate) != 0
            steps.append(F.when(ok, cell.bitwiseXOR(c)))
        near = F.when(F.bit_count(cell) % 2 == 0, F.array_compact(F.array(*steps))).otherwise(F.array().cast("array<bigint>"))
        homes.append(e.select(F.lit(i).alias("band"), cell.alias("cell"), F.col("fp").alias("a"), F.col("e").alias("ea"), cell.alias("own")))
        probes.append(e.select(F.lit(i).alias("band2"), F.explode(F.concat(F.array(cell), near)).alias("cell2"),
                               F.col("fp").alias("b"), F.col("e").alias("eb"), cell.alias("own2")))
    h, p = homes[0], probes[0]
    for x, y in zip(homes[1:], probes[1:]):
        h, p = h.union(x), p.union(y)
    hit = h.join(p, (F.col("band") == F.col("band2")) & (F.col("cell") == F.col("cell2"))
                 & ((F.col("own") != F.col("own2")) | (F.col("a") < F.col("b")))
                 & (F.bit_count(F.col("ea").bitwiseXOR(F.col("eb"))) <= max_bits)
                 & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
    return hit.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(_id, _tie, fp, label, component_id) for each input row; label, the least fingerprint, names the component."""
    rows = written(fingerprints(docs, doc_id, text, shingle), "simhash")
    groups = written(rows.groupBy("fp").agg(F.min("_id").alias("least")), "simhash-groups")
    label = components(links(groups, max_bits)).withColumnRenamed("node", "fp")
    of = groups.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    ids = of.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = written(of.select("fp", "label").join(ids, "label").select(F.col("fp").alias("_fp"), "label", "component_id"), "simhash-ids")
    return rows.join(ids, F.col("fp") == F.col("_fp")).select("_id", "_tie", "fp", "label", "component_id")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents that stay: of each component the row with the smallest id (ties: smallest text hash, then one row).

    Components without any id keep the row with the smallest text hash.
    """
    d = seal(docs, _doc=doc_id, _text=text)
    near = near_duplicates(d, "_doc", "_text", shingle, max_bits)
    # one winner for each component: an aggregate with map-side minimum
    win = near.groupBy("label").agg(F.min(F.struct(F.col("_id").isNull().alias("n"), "_id", "_tie")).alias("w"))
    win = written(win.select(id_key(F.col("w._id")).alias("_wk"), F.col("w._tie").alias("_wt")).distinct(), "simhash-kept")
    d = d.withColumns({"_key": id_key(F.col("_doc")), "_tie": text_tie(F.coalesce(F.col("_text"), F.lit("")))})
    kept = d.join(win, (F.col("_key") == F.col("_wk")) & (F.col("_tie") == F.col("_wt")), "left_semi")
    # repeated rows of one id and text: one stays (the join has grouped and sorted them already)
    one = F.row_number().over(Window.partitionBy("_key", "_tie").orderBy("_key"))
    return unseal(kept.withColumn("_n", one).where("_n = 1"), docs, text)
