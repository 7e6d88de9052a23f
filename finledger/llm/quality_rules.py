"""Quality rules (native): cross-document line frequency and in-document statistics.

Method: every non-blank line is normalised (A-Z lower-cased, digits to ``0``,
runs of spaces collapsed) and hashed; distinct documents are counted per
(host, line); lines above ``max_docs`` are removed from every document but
the one with the smallest id that carries them; a document that keeps less
than ``min_kept`` of its words is depleted and rejected.

Copies: documents with equal texts count once for a line, so a group of exact
copies does not make its own lines frequent; more than ``max_docs`` near copies do.
The first carrier keeps its lines. It is the smallest id of any document, also of one
that is rejected (by the base rule, or depleted); then the line goes with it.

Defined cases: null text = empty text (no lines, no words; fails the base
rule); null host is a host of its own; repeated rows get equal verdicts; rows
of one id with different texts are judged apart; an empty table gives an
empty result; other columns of the input, whatever their names, pass through :func:`clean` untouched.

Everything is built-in expressions. The lines' hashes are written once and read
by both sides of the join. Shuffled are hashes and counts, never texts, except in :func:`clean`, which joins the lines to remove back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finledger.llm._common import LOWER, SPACES, UPPER, seal, text_or_empty, text_tie, unseal, words, written

SYMBOLS = "#*$%&|<>"
MAX_DOCS = 20        # a line in more distinct documents of one host is boilerplate
MIN_KEPT = 0.3       # share of words a document must keep
MIN_WORDS = 50       # base rule
MAX_REPEAT = 50      # base rule: percent of words in repeated 3-word windows


def line_hashes(text: Column) -> Column:
    """For each ``\\n``-split line, in order: hash of its normalised words and how many there are."""
    low = F.translate(text, UPPER + SPACES.replace("\n", "") + "123456789", LOWER + " " * (len(SPACES) - 1) + "0" * 9)
    split = F.transform(F.split(low, "\n"), lambda x: F.filter(F.split(x, " "), lambda w: w != ""))
    return F.transform(split, lambda ws: F.struct(F.xxhash64(F.array_join(ws, " ")).alias("h"), F.size(ws).alias("w")))


def has_word(line: Column) -> Column:
    return F.translate(line, SPACES, "") != ""


def _repeat_words(w: str) -> Column:
    """Words covered by 3-word windows that occur at least twice, from the sorted (hash, position) windows ``w``."""
    x = F.col(w)
    twice = F.filter(x, lambda e, i: (F.get(x, i - 1)["h"] == e["h"]) | (F.get(x, i + 1)["h"] == e["h"]))
    return F.sort_array(F.transform(twice, lambda e: e["p"]))


def document_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (row by row, no shuffle)."""
    t = text_or_empty(text)
    d = docs.withColumn("_w", words(t))
    d = d.withColumn("_lines", F.filter(F.split(t, "\n"), has_word))
    ws, n = F.col("_w"), F.size("_w")
    d = d.withColumn("_h", F.when(n >= 3, F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2))
    )).otherwise(F.array().cast("array<bigint>")))
    hs = F.col("_h")
    # sorting structs is the costly step: only where some window does repeat
    d = d.withColumn("_s", F.when(F.size(F.array_distinct(hs)) < F.size(hs), F.sort_array(
        F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))))
    d = d.withColumn("_p", F.when(F.col("_s").isNotNull(), _repeat_words("_s")))
    p = F.col("_p")
    covered = F.aggregate(
        F.transform(p, lambda q, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - q, F.lit(3)))),
        F.lit(0).cast("int"), lambda a, b: a + b)
    d = d.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    })
    failed = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT) * F.col("n_words"))
    return d.withColumn("base_failed", failed).drop("_w", "_h", "_s", "_p", "_lines")


def document_lines(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """One row per line with a word: (_id, _tie, _host, _pos, _line, _words); _pos counts all lines from 0, _line is the hash of the normalised line."""
    t = text_or_empty(text)
    placed = F.transform(line_hashes(t), lambda x, i: F.struct(x["h"].alias("h"), x["w"].alias("w"), i.alias("p")))
    d = docs.select(F.col(doc_id).alias("_id"), text_tie(t).alias("_tie"), F.col(host).alias("_host"), F.explode(F.filter(placed, lambda x: x["w"] > 0)).alias("_l"))
    return d.select("_id", "_tie", "_host", F.col("_l.p").alias("_pos"), F.col("_l.h").alias("_line"), F.col("_l.w").cast("long").alias("_words"))


def frequent_lines(lines: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, line) in more than ``max_docs`` distinct documents, with the smallest id that carries it.

    Two aggregates with map-side combining; no key is ever gathered in one task.
    """
    per_text = lines.groupBy("_host", "_line", "_tie").agg(F.min("_id").alias("_first"))
    return (per_text.groupBy("_host", "_line")
            .agg(F.count(F.lit(1)).alias("_docs"), F.min("_first").alias("_first"))
            .where(F.col("_docs") > max_docs))


def removals(lines: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """Lines to take out of each document: the frequent ones it is not the first carrier of."""
    f = frequent_lines(lines, max_docs).select(F.col("_host").alias("_fh"), F.col("_line").alias("_fl"), "_first")
    hit = lines.join(f, (F.col("_line") == F.col("_fl")) & F.col("_host").eqNullSafe(F.col("_fh")))
    return hit.where(~F.col("_id").eqNullSafe(F.col("_first"))).select("_id", "_tie", "_pos", "_line", "_words")


def judge(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text",
          max_docs: int = MAX_DOCS, min_kept: float = MIN_KEPT) -> DataFrame:
    """Per row: (_id, _tie), the statistics, ``n_line_words`` removed by line frequency, base_failed and kept.

    Only numbers and hashes are shuffled.
    """
    stats = document_stats(docs.select(F.col(doc_id).alias("_id"), F.col(host).alias("_host"), F.col(text).alias("_text")), "_text")
    stats = stats.withColumn("_tie", text_tie(text_or_empty("_text"))).drop("_text", "_host")
    out = removals(written(document_lines(docs, doc_id, host, text), "lines"), max_docs)
    # rows of one id with one text are repeated rows: each has the same lines, counted once per row
    gone = out.groupBy("_id", "_tie").agg(F.sum("_words").alias("_gone"))
    copies = stats.groupBy("_id", "_tie").agg(F.count(F.lit(1)).alias("_rows"), *[F.first(c).alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")])
    g = gone.select(F.col("_id").alias("_gid"), F.col("_tie").alias("_gt"), "_gone")
    j = copies.join(g, F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_tie") == F.col("_gt")), "left").drop("_gid", "_gt")
    j = j.withColumn("n_line_words", (F.coalesce("_gone", F.lit(0)) / F.col("_rows")).cast("long"))
    depleted = (F.col("n_words") - F.col("n_line_words")) < F.lit(min_kept) * F.col("n_words")
    j = j.withColumn("kept", ~F.col("base_failed") & ~depleted)
    return j.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int")))).drop("_gone", "_rows", "_copy")


def clean(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text",
          max_docs: int = MAX_DOCS, min_kept: float = MIN_KEPT) -> DataFrame:
    """The kept documents, frequent lines removed from their texts; all other columns as they were."""
    d = seal(docs, _doc=doc_id, _from=host, _text=text)
    out = removals(written(document_lines(d, "_doc", "_from", "_text"), "lines"), max_docs)
    # a set of at most a document's own lines; repeated rows of a document have the same
    per_doc = out.groupBy(F.col("_id").alias("_pid"), F.col("_tie").alias("_pt")).agg(F.collect_set(F.struct("_pos", "_words")).alias("_set"))
    per_doc = per_doc.select("_pid", "_pt", F.transform("_set", lambda x: x["_pos"]).alias("_out"),
                             F.aggregate("_set", F.lit(0).cast("long"), lambda a, x: a + x["_words"]).alias("_gone"))
    stats = document_stats(d.withColumn("_tie", text_tie(text_or_empty("_text"))), "_text")
    j = stats.join(per_doc, F.col("_doc").eqNullSafe(F.col("_pid")) & (F.col("_tie") == F.col("_pt")), "left")
    # one expression over both sides of the join: pushed below it, the optimizer would inline the
    # statistics into the filter and evaluate whole arrays for each element
    left_words = F.col("n_words") - F.coalesce(F.col("_gone"), F.lit(0))
    j = j.where(F.when(F.col("base_failed"), False).otherwise(left_words >= F.lit(min_kept) * F.col("n_words")))
    # positions are taken out by a hash set, so a document costs what its lines cost
    j = j.withColumn("_ls", F.split("_text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_ls") - 1), F.col("_out"))
    left = F.array_join(F.transform(stay, lambda p: F.get("_ls", p)), "\n")
    return unseal(j.withColumn("_new", F.when(F.col("_out").isNull(), F.col("_text")).otherwise(left)), docs, text, "_new")
