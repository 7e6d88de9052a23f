"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: sources in code-point order (null last) weigh ``weights`` repeating
and share ``share`` of all sizes; a target stops at ``most`` times its source's
size and the excess is shared again by weight (closed form over the sources
sorted by size / weight, no iteration).

Selection within a source: every document has the exponential key
``-ln(u) / w`` with ``u`` from a seeded hash of its id and ``w`` its quality
weight; documents in ascending key order are a weighted sample without
replacement. Whole epochs of the source come first (every document once for
each), the rest of the target is the fractional epoch: the first documents in
key order whose sizes, summed along the order, reach it (the document on the edge is
taken if that brings the sum nearer).

Because the selection is a prefix of the key order, it is given by one
boundary key for each source. The sums are taken over about sqrt(n) key ranges of
each source, then over the documents of the one range where the target falls:
no source is ever sorted or summed in one task, however hot it is, and texts
are not shuffled at all.

Defined cases: null text has size 0; a null source is a source of its own,
after all others; a source without words gets target 0; documents of size 0
are selected like others but take no words; repeated rows with
equal id and text share a key: they are ordered by nothing and taken together;
rows of one id with different texts are ordered by a hash of the text; a null
id has the key of the text ``null``; an empty table gives an empty result.
Input columns, whatever their names, pass through :func:`mix`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finledger.llm._common import buckets_for, seal, text_or_empty, text_tie, uniform, unseal, words, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 17
LEAST_QUALITY = 0.25
SYMBOLS = "#*$%&|<>"


def quality_weight(text: Column) -> Column:
    """A weight in [LEAST_QUALITY, 1]: falls with the share of symbol characters (a tenth or more of them: the least)."""
    n = F.length(text)
    symbols = (n - F.length(F.translate(text, SYMBOLS, ""))).cast("double")
    share = F.least(F.lit(1.0), F.lit(10.0) * symbols / F.greatest(n, F.lit(1)).cast("double"))
    return F.lit(1.0) - F.lit(1.0 - LEAST_QUALITY) * share


def keyed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
          weight: Column | None = None, seed: int = SEED) -> DataFrame:
    """Adds _src (never null), _nosrc, _size, _key, _tie. ``weight`` lies in [LEAST_QUALITY, 1]."""
    t = text_or_empty(text)
    w = quality_weight(t) if weight is None else weight
    return docs.withColumns({
        "_src": F.coalesce(F.col(source), F.lit("")),
        "_nosrc": F.col(source).isNull(),
        "_size": F.size(words(t)).cast("long"),
        "_key": -F.ln(uniform(seed, F.col(doc_id))) / w,
        "_tie": text_tie(t),
    })


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(_src, _nosrc, source_size) -> adds target. One row for each source; windows run over sources only."""
    order = Window.orderBy("_nosrc", "_src")
    i = F.row_number().over(order) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (i % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * most
    s = sizes.withColumn("_w", w).withColumn("_cap", cap.cast("double")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    rising = Window.orderBy("_ratio", "_nosrc", "_src").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything).cast("double") * share
    full_w = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(rising), F.lit(0.0))
    s = s.withColumn("_level", (total - F.coalesce(F.sum("_cap").over(rising), F.lit(0.0))) / full_w)
    # the level of the first source (in rising order) that its level does not fill
    s = s.withColumn("_lam", F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "_nosrc", "_src", "_level"))).over(everything)["_level"])
    return s.select("_src", "_nosrc", "source_size",
                    F.when(F.col("_lam").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_lam") * F.col("_w"))).alias("target"))


def boundaries(rows: DataFrame, n: int, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row for each source: source_size, target, epochs, and the key and tie up to which (both included) one more copy is taken.

    ``rows``: _src, _nosrc, _size, _key, _tie; a written table, read three times.
    """
    nb = buckets_for(n)
    # 1 - exp(-least weight * key) rises with the key and spreads keys over [0, 1): no range holds more
    # than (greatest weight / least weight) times its even share of a source
    bucket = F.floor((F.lit(1.0) - F.exp(-F.lit(LEAST_QUALITY) * F.col("_key"))) * nb).cast("long")
    cut = rows.withColumn("_b", bucket)
    sums = cut.groupBy("_src", "_nosrc", "_b").agg(F.sum("_size").alias("_n"))
    sizes = sums.groupBy("_src", "_nosrc").agg(F.sum("_n").alias("source_size"))
    t = source_targets(sizes, weights, share, most)
    t = t.withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long"))
    t = written(t.withColumn("_rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size"))), "mix-sources")
    up = Window.partitionBy("_src", "_nosrc").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    edge = sums.withColumn("_before", F.coalesce(F.sum("_n").over(up), F.lit(0)))
    # the range in which the rest of the target falls
    edge = (edge.join(t.select("_src", "_nosrc", "_rest"), ["_src", "_nosrc"])
            .where((F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_n") >= F.col("_rest")))
            .select(F.col("_src").alias("_es"), F.col("_nosrc").alias("_en"), F.col("_b").alias("_eb"), "_before", "_rest"))
    edge = written(edge, "mix-edges")
    inside = cut.join(edge, (F.col("_src") == F.col("_es")) & (F.col("_nosrc") == F.col("_en")) & (F.col("_b") == F.col("_eb")))
    same = inside.groupBy("_src", "_nosrc", "_before", "_rest", "_key", "_tie").agg(F.sum("_size").alias("_s"))
    run = Window.partitionBy("_src", "_nosrc").orderBy("_key", "_tie")
    at = same.withColumn("_upto", F.col("_before") + F.sum("_s").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    # taken if at least half of it lies within the rest: nearer with it than without
    at = at.where(F.col("_upto").cast("double") - F.col("_s") / F.lit(2.0) <= F.col("_rest"))
    last = at.groupBy("_src", "_nosrc").agg(F.max(F.struct("_key", "_tie")).alias("_last"))
    # nothing of the edge range taken: everything before it is
    le = edge.select(F.col("_es").alias("_src"), F.col("_en").alias("_nosrc"), F.col("_eb"))
    out = t.join(le, ["_src", "_nosrc"], "left").join(last, ["_src", "_nosrc"], "left")
    return out.select("_src", "_nosrc", "source_size", "target", "epochs", F.col("_eb").alias("_edge"),
                      F.col("_last._key").alias("_lkey"), F.col("_last._tie").alias("_ltie"), F.lit(nb).alias("_nb"))


def copies(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Adds source_size, target, epochs and copies (how often the mix takes the document) to keyed rows."""
    b = bounds.select(F.col("_src").alias("_bs"), F.col("_nosrc").alias("_bn"), *[c for c in bounds.columns if c not in ("_src", "_nosrc")])
    j = rows.join(b, (F.col("_src") == F.col("_bs")) & (F.col("_nosrc") == F.col("_bn")))
    bucket = F.floor((F.lit(1.0) - F.exp(-F.lit(LEAST_QUALITY) * F.col("_key"))) * F.col("_nb")).cast("long")
    inside = (bucket == F.col("_edge")) & (
        (F.col("_key") < F.col("_lkey")) | ((F.col("_key") == F.col("_lkey")) & (F.col("_tie") <= F.col("_ltie"))))
    more = F.when(F.col("_edge").isNull(), 0).when(bucket < F.col("_edge"), 1).when(inside, 1).otherwise(0)
    return j.withColumn("copies", (F.col("epochs") + more).cast("long")).drop("_bs", "_bn", "_edge", "_lkey", "_ltie", "_nb")


def plan_mix(rows: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Boundaries of the mix for a written table of keyed rows, themselves written (one row for each source)."""
    return written(boundaries(rows, rows.count(), weights, share, most), "mix-plan")


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
        weight: str | None = None, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
        most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it. Texts are read twice and never shuffled."""
    d = seal(docs, _doc=doc_id, _from=source, _text=text, **({"_quality": weight} if weight else {}))
    k = keyed(d, "_doc", "_from", "_text", F.col("_quality") if weight else None, seed)
    bounds = plan_mix(written(k.select("_src", "_nosrc", "_size", "_key", "_tie"), "mix-keys"), weights, share, most)
    out = copies(k, bounds).where("copies > 0")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return unseal(out, docs, text)
