"""Sharding (native): proportional stratified interleaving.

Rows are ranked within their source in a seeded shuffled order; the fractional
rank ``(rank - u) / rows of the source``, with a seeded phase u in (0, 1) for each
source, spreads each source evenly over [0, 1) and many tiny sources evenly too. All rows sorted by it are cut into equal runs: any run, hence every
shard, holds the sources in the proportions of the whole. The law is
``rows``: shard sizes are at most one row apart.

Both ranks are exact and global without a one-task sort: they run in about
sqrt(n) ranges of a uniform number (the seeded hash, then the fractional rank)
with added range offsets. Only narrow rows are shuffled, never texts.

Defined cases: null text has no bytes (size 1 with its separator, crc32 of
nothing); a null source is a stratum of its own; repeated rows are dealt each
and are interchangeable; the shuffled order is that of the id and a hash of the text, and rows of an id and text that
more than about sqrt(n) rows share (or of a null id and one text) are spread by their place in the input; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finledger.llm._common import ranked, text_or_empty, text_tie, uniform, with_uniform, written

SHARDS = 8
SEED = 41


def narrow_rows(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """What dealing needs of each row: _id, _src (never null), _nosrc, _tie, size, text_crc32 and _i, a number of its own."""
    t = text_or_empty(text)
    return docs.select(
        F.col(doc_id).alias("_id"), F.coalesce(F.col(source), F.lit("")).alias("_src"), F.col(source).isNull().alias("_nosrc"),
        text_tie(t).alias("_tie"), F.monotonically_increasing_id().alias("_i"),
        (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"))


def interleave(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Adds position (0-based, over all rows), shard and slot to written rows of :func:`narrow_rows`."""
    n = rows.count()
    rows = with_uniform(rows, n, seed, ["_id", "_tie"], "_i")
    order = ["_u", "_id", "_tie", "size", "text_crc32"]
    within = ranked(rows, n, ["_src", "_nosrc"], F.col("_u"), order, "_rank")
    per = written(rows.groupBy("_src", "_nosrc").agg(F.count(F.lit(1)).alias("_rows")), "shard-sources")
    within = within.join(per.select(F.col("_src").alias("_ps"), F.col("_nosrc").alias("_pn"), "_rows"),
                         (F.col("_src") == F.col("_ps")) & (F.col("_nosrc") == F.col("_pn"))).drop("_ps", "_pn")
    within = within.withColumn("_f", (F.col("_rank") - uniform(seed, F.col("_src"), F.col("_nosrc"))) / F.col("_rows"))
    within = written(within, "shard-ranks")
    placed = ranked(within, n, [], F.col("_f"), ["_f", "_nosrc", "_src", "_rank"], "_pos")
    pos = F.col("_pos") - 1
    # shard s holds the positions from ceil(s n / shards) to before ceil((s + 1) n / shards)
    shard = F.expr(f"((_pos - 1) * {shards}) div {max(1, n)}")
    first = F.expr(f"(shard * {max(1, n)} + {shards - 1}) div {shards}")
    return placed.withColumn("position", pos).withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("position") - first).cast("long"))


def deal(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
         shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One narrow row for each document: its id, source, size, text_crc32, position, shard and slot."""
    rows = written(narrow_rows(docs, doc_id, source, text), "shard-rows")
    out = interleave(rows, shards, seed)
    return out.select(F.col("_id").alias(doc_id), F.when(~F.col("_nosrc"), F.col("_src")).alias(source),
                      "size", "text_crc32", "position", "shard", "slot")
