"""Document fingerprints (native): bottom-k sketches of word-shingle hashes.

A sketch is the sorted array of the ``k`` smallest distinct hashes of a text's
``shingle``-word shingles. Sketches of parts merge to the sketch of the whole;
two of them estimate resemblance and containment, one the number of
distinct shingles.

Everything is built-in array expressions on the row; only
:func:`merge_groups` and :func:`with_next` shuffle.

Defined cases: null text = empty text; a text without words has the empty sketch;
fewer words than ``shingle``: one shingle of all words. Two empty sketches resemble
each other by 1, an empty and a filled one by 0. Equal texts have equal sketches.
In :func:`with_next` null ids sort last, rows of one id by a hash of the text, repeated
rows stand next to each other; the row after the last is the first; a single row is its own next;
an empty table gives an empty result; other columns, whatever their names, pass through.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finledger.llm._common import seal, text_or_empty, text_tie, unseal, words, written

K = 64
SHINGLE = 5
_NULL_ID = (1 << 63) - 1
_RANGE_BYTES = 8 << 20   # text of one range of ids


def shingle_hashes(w: str, shingle: int = SHINGLE) -> Column:
    """Hashes of the shingles of the word-array column ``w`` (referenced by name: it must be a real column)."""
    ws, n = F.col(w), F.size(w)
    many = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(shingle)]))
    few = F.array(F.xxhash64(F.array_join(ws, " ")))
    return F.when(n >= shingle, many).when(n > 0, few).otherwise(F.array().cast("array<bigint>"))


def bottom_k(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Adds ``out``, the sketch of ``text``."""
    d = df.withColumn("_w", words(text_or_empty(text)))
    return d.withColumn(out, bottom_k(shingle_hashes("_w", shingle), k)).drop("_w")


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: the share of the union's sketch that both have."""
    u = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(u, a), b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.greatest(F.size(u), F.lit(1)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else from the k-th smallest hash."""
    kth = F.element_at(a, -1).cast("double") + F.lit(float(1 << 63))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) * F.lit(float(1 << 64)) / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    j = resemblance(a, b, k)
    na, nb = distinct_shingles(a, k), distinct_shingles(b, k)
    both = j * (na + nb) / (F.lit(1.0) + j)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / F.greatest(na, F.lit(1.0))))


def merge_groups(df: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """One merged sketch for each key: (keys, sketch). Each task passes on its k smallest hashes of a key at most."""
    h = df.select(*keys, F.explode(sketch).alias("_h")).distinct()
    r = h.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))).where(F.col("_r") <= k)
    some = r.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(sketch))
    none = df.select(*keys).distinct().join(some.select(*keys), keys, "left_anti")
    return some.unionByName(none.withColumn(sketch, F.array().cast("array<bigint>")))


def as_text(sketch: Column) -> Column:
    """Hexadecimal digits of the hashes, 16 for each."""
    return F.lower(F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def _range_of(id_: Column, cuts: list[int]) -> Column:
    """How many cut points lie below the id: binary search on a constant array."""
    if not cuts:
        return F.lit(0)
    c = F.lit(cuts)
    steps = F.array(*[F.lit(1 << j) for j in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.coalesce(F.get(c, at + s - 1) < id_, F.lit(False)), at + s).otherwise(at))


def _cuts(quantiles: list[int], ranges: int, nulls: int, rows: int) -> tuple[list[int], list[int]]:
    """The distinct cut points, and for each range into how many parts its last id is split (of the last range: null ids).

    An id that is several quantiles in a row has that many shares of the rows.
    """
    times = Counter(quantiles)
    cuts = sorted(times)
    return cuts, [*[times[c] for c in cuts], max(1, -(-ranges * nulls // max(1, rows)))]


def _part_of(id_: Column, tie: Column, range_: Column, cuts: list[int], parts: list[int]) -> Column:
    """The row's range with the part of it, in the order of ids and ties: 0 for ids before the range's last one, then by tie."""
    n, most = F.get(F.lit(parts), range_), max(parts)
    part = F.floor((tie.cast("double") / F.lit(2.0 ** 64) + F.lit(0.5)) * n).cast("int")
    hot = (n > 1) & (id_ == F.get(F.lit([*cuts, _NULL_ID]), range_))
    return range_ * F.lit(most + 1) + F.when(hot, F.least(part, n - 1) + 1).otherwise(0)


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Adds fingerprint, and of the next document by ascending id: next_text and next_fingerprint.

    Rows are dealt once by ranges of ids (cut points are quantiles), an id of many rows
    by ranges of its ties; the first
    row of each range also goes, marked, to the end of the range before it,
    so every window is local and no task sees more than its range.
    """
    t = text_or_empty(text)
    d = seal(docs, _doc=doc_id, _text=text)
    d = d.withColumns({"_id": F.coalesce("_doc", F.lit(_NULL_ID)), "_tie": text_tie(text_or_empty("_text"))})
    size = docs.agg(F.sum(F.octet_length(t)).alias("b"), F.count(F.lit(1)).alias("n"),
                    F.count_if(F.col(doc_id).isNull()).alias("nulls")).first()
    total, n = size["b"] or 0, size["n"]
    ranges = max(1, min(math.isqrt(n), max(-(-total // _RANGE_BYTES), min(256, -(-total // (256 << 10))))))
    quantiles = []
    if ranges > 1:
        share = [i / ranges for i in range(1, ranges)]
        quantiles = docs.agg(F.percentile_approx(doc_id, share, max(10_000, 10 * ranges)).alias("q")).first()["q"] or []
    cuts, parts = _cuts(quantiles, ranges, size["nulls"], n)
    d = d.withColumn("_range", _range_of(F.col("_id"), cuts))
    d = d.withColumn("_range", _part_of(F.col("_id"), F.col("_tie"), F.col("_range"), cuts, parts))
    # the first row of each range and the range before it (of the first range: the last); about twice ``ranges`` rows at most
    firsts = d.groupBy("_range").agg(F.min(F.struct("_id", "_tie")).alias("f"))
    order = Window.orderBy("_range")
    last = F.max("_range").over(Window.partitionBy())
    firsts = firsts.select(F.col("f._id").alias("_fid"), F.col("f._tie").alias("_ftie"), F.coalesce(F.lag("_range").over(order), last).alias("_to"))
    firsts = written(firsts, "fingerprint-firsts")
    j = d.join(F.broadcast(firsts), (F.col("_id") == F.col("_fid")) & (F.col("_tie") == F.col("_ftie")), "left")
    here = F.struct(F.col("_range").alias("r"), F.lit(False).alias("m"))
    there = F.when(F.col("_to").isNotNull(), F.struct(F.col("_to").alias("r"), F.lit(True).alias("m")))
    j = j.withColumn("_at", F.explode(F.array_compact(F.array(here, there))))
    j = j.withColumns({"_r": F.col("_at.r"), "_m": F.col("_at.m")}).drop("_at", "_range", "_fid", "_ftie", "_to").repartition("_r")
    j = with_sketch(j, "_text", "fingerprint", k, shingle)
    w = Window.partitionBy("_r").orderBy("_m", "_id", "_tie")
    j = j.withColumns({"next_text": F.lead(text_or_empty("_text")).over(w), "next_fingerprint": F.lead("fingerprint").over(w)})
    return unseal(j.where(~F.col("_m")), docs, text, added=["fingerprint", "next_text", "next_fingerprint"])


def edited_text(text: Column, next_text: Column) -> Column:
    """The last quarter of the code points replaced by as many first ones of the next text."""
    n = F.length(text)
    m = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - m), F.substring(next_text, F.lit(1), m))
