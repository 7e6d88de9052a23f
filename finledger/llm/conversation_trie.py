"""Prefix trie of conversations by whole-sequence collapse.

Identical conversations are grouped into one weighted sequence with the list of those that end there;
sequences that are a proper prefix of another are dropped by an anti-join, which leaves the leaves; the prefixes of the weighted sequences,
aggregated, are the nodes of the trie.

A prefix is known by its key: four sums over its turns of 32-bit parts of a hash of (position, turn), where
the turn is an md5 of role and text. So the keys of all prefixes of a conversation are running sums, which a
long conversation computes in ranges that are added up (:func:`numbered`): no task holds more of a conversation than one range.

Sums over subtrees need no walk from parent to child. With n(u) members and w(u) words of the last text of node u,

* the sum of n(u) w(u) below node v is, over the sequences through v, weight times the words from v's turn on;
* the sum of w(u) below v counts every node once: each node belongs to the smallest leaf below it, so a leaf owns an end part of its path,
  and the sum is, over the leaves through v, the words of the owned part from v's turn on.

Only narrow rows are shuffled after the first pass (ids, positions, hashes, word counts), never texts. Every step is an aggregate with map-side
combining, or a join whose hot side AQE splits. The only group that goes through one task in order is the end list of one
sequence, as SHA-256 is a hash of a stream: it arrives as chunks of 64 KB and is never held whole.

Defined cases: turns are ordered by turn (null first), equal ones by their md5, so equal rows are interchangeable; a null role or text is
empty; a turn without a conversation (null conv_id) belongs to none and is left out; repeated rows are turns each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finledger.llm._common import text_or_empty, words, written

FAMILY = 20               # conversations of one family start like its first one
MOST_SHARED = 4           # ... for 0 to 3 turns
_CHUNK = 64 << 10         # characters of one chunk of an end list
_KEY = ["_k0", "_k1", "_k2", "_k3"]


def turns_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(_c, _t, _m, _w): conversation, turn, md5 of role and text, words of the text; a written table without texts."""
    r, t = text_or_empty(F.col(f"`{role}`")), text_or_empty(F.col(f"`{text}`"))
    whole = F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t)
    rows = conversations.select(
        F.col(f"`{conv_id}`").cast("long").alias("_c"), F.col(f"`{turn}`").alias("_t"),
        F.unhex(F.md5(whole.cast("binary"))).alias("_m"), F.size(words(t)).cast("long").alias("_w"))
    return written(rows.where(F.col("_c").isNotNull()), "trie-turns")


def numbered(turns: DataFrame) -> DataFrame:
    """Adds _p, the position in the conversation from 1, and _b, the number of the conversation's range: a written table.

    Rows are dealt by ranges of (conversation, turn), so a conversation of any length is many ranges of even size.
    Only the first conversation of a range can have begun before it: the table of what lies before has at most as many rows as there are ranges.
    """
    # the row's number in the written table parts even equal rows
    order = ["_c", F.col("_t").asc_nulls_first(), "_m", "_i"]
    dealt = turns.withColumn("_i", F.monotonically_increasing_id()).repartitionByRange(*order)
    dealt = written(dealt.withColumn("_part", F.spark_partition_id()), "trie-ranges")
    of = Window.partitionBy("_c", "_part").orderBy(F.col("_t").asc_nulls_first(), "_m")
    rows = dealt.withColumn("_p", F.row_number().over(of).cast("long"))
    before = Window.partitionBy("_c").orderBy("_part")
    sizes = dealt.groupBy("_c", "_part").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumns({"_off": F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), "_nth": F.row_number().over(before) - 1})
    sizes = sizes.where("_nth > 0").select(F.col("_c").alias("_oc"), F.col("_part").alias("_op"), "_off", "_nth")
    rows = rows.join(F.broadcast(sizes), (F.col("_c") == F.col("_oc")) & (F.col("_part") == F.col("_op")), "left")
    return written(rows.select("_c", (F.col("_p") + F.coalesce("_off", F.lit(0))).alias("_p"), F.coalesce("_nth", F.lit(0)).alias("_b"), "_m", "_w"),
                   "trie-numbered")


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the first one of its family."""
    return F.crc32(conv.cast("string").cast("binary")) % MOST_SHARED


def rebuilt(rows: DataFrame) -> DataFrame:
    """Rows of :func:`numbered` after every conversation took its first turns from the first one of its family (none if that is absent).

    Its own turns follow from the same position on. A row at position 0 stands for the conversation itself.
    """
    first = F.col("_c") - F.col("_c") % FAMILY
    convs = rows.groupBy("_c").agg(F.max("_p").alias("_own"))
    convs = written(convs.select("_c", "_own", first.alias("_first"), shared_turns(F.col("_c")).alias("_h")), "trie-conversations")
    has = convs.where(F.col("_c") == F.col("_first")).select(F.col("_c").alias("_fc"), "_own")
    wants = convs.select("_c", "_first", "_h").where("_h > 0")
    # conversations that find fewer turns than they take: their own ones move up
    short = wants.join(has, F.col("_first") == F.col("_fc"), "left")
    short = short.select(F.col("_c").alias("_sc"), (F.col("_h") - F.least("_h", F.coalesce("_own", F.lit(0)))).alias("_less")).where("_less > 0")
    own = rows.where(F.col("_p") > shared_turns(F.col("_c"))).join(short, F.col("_c") == F.col("_sc"), "left")
    own = own.select("_c", (F.col("_p") - F.coalesce("_less", F.lit(0))).alias("_p"), "_b", "_m", "_w")
    heads = rows.where((F.col("_c") == first) & (F.col("_p") < MOST_SHARED)).select(F.col("_c").alias("_fc"), "_p", "_m", "_w")
    taken = wants.join(heads, (F.col("_first") == F.col("_fc")) & (F.col("_p") <= F.col("_h")))
    taken = taken.select("_c", "_p", F.lit(0).alias("_b"), "_m", "_w")
    roots = convs.select("_c", F.lit(0).cast("long").alias("_p"), F.lit(0).alias("_b"), F.lit(None).cast("binary").alias("_m"), F.lit(0).cast("long").alias("_w"))
    return own.unionByName(taken).unionByName(roots)


def _hashed(rows: DataFrame) -> DataFrame:
    """Adds the four parts of the hash of (position, turn): 0 for position 0."""
    d = rows.withColumns({"_x": F.xxhash64("_p", "_m"), "_y": F.xxhash64(F.lit(1), "_p", "_m")})
    low = F.lit((1 << 32) - 1)
    parts = [F.col("_x").bitwiseAND(low), F.shiftright("_x", 32), F.col("_y").bitwiseAND(low), F.shiftright("_y", 32)]
    return d.withColumns({k: F.when(F.col("_p") > 0, x).otherwise(F.lit(0).cast("long")) for k, x in zip(_KEY, parts)}).drop("_x", "_y")


def _same(a: list[str], b: list[str]) -> Column:
    cond = F.col(a[0]) == F.col(b[0])
    for x, y in zip(a[1:], b[1:]):
        cond = cond & (F.col(x) == F.col(y))
    return cond


def _as(names: list[str], prefix: str) -> list[Column]:
    return [F.col(n).alias(prefix + n) for n in names]


def _prefixes(rows: DataFrame, sequences: DataFrame) -> DataFrame:
    """One row for each prefix of each distinct sequence: its key, that of its parent, _before (words before its last turn); a written table."""
    picked = rows.join(sequences.select(F.col("_rep"), "_weight", "_all", "_len"), F.col("_c") == F.col("_rep")).drop("_rep")
    sums = [*_KEY, "_w"]
    per = picked.groupBy("_c", "_b").agg(*[F.sum(s).alias(s) for s in sums])
    before = Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_c", "_b", *[F.sum(s).over(before).alias("_o" + s) for s in sums]).where("_b > 0")  # at most as many rows as ranges
    run = Window.partitionBy("_c", "_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = picked.withColumns({"_s" + s: F.sum(s).over(run) for s in sums})
    d = d.join(F.broadcast(per.withColumnsRenamed({"_c": "_oc", "_b": "_ob"})), (F.col("_c") == F.col("_oc")) & (F.col("_b") == F.col("_ob")), "left")
    total = {s: F.col("_s" + s) + F.coalesce(F.col("_o" + s), F.lit(0)) for s in sums}
    return written(d.select(
        F.col("_c").alias("_rep"), F.col("_p").alias("_depth"), "_weight", "_all", "_len", F.col("_w").alias("_last"), (total["_w"] - F.col("_w")).alias("_before"),
        *[total[k].alias(k) for k in _KEY], *[(total[k] - F.col(k)).alias("_up" + k) for k in _KEY]), "trie-prefixes")


def end_lists(ends: DataFrame) -> DataFrame:
    """(_c, key) -> (key, ends_sha256): SHA-256 of the decimal ids of a key, ascending, joined by commas.

    Ids are dealt by ranges, and each range's ids of a key become chunks of text; the chunks of a key then pass through one
    hash state in the order of their first ids.
    """

    def chunks(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, first, ids, size, rows = None, None, [], 0, []

        def flushed():
            if ids:
                rows.append((*key, first, ",".join(ids)))

        for b in batches:
            for *k, c in zip(*[col.to_pylist() for col in b.columns]):
                if k != key or size >= _CHUNK:
                    flushed()
                    key, first, ids, size = k, c, [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], [*_KEY, "_first", "_ids"])
                rows.clear()
        flushed()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], [*_KEY, "_first", "_ids"])

    def hashes(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        key, state, rows = None, None, []
        for b in batches:
            for *k, ids in zip(*[col.to_pylist() for col in b.columns]):
                if k != key:
                    if key is not None:
                        rows.append((*key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(("," + ids).encode())
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], [*_KEY, "ends_sha256"])
                rows.clear()
        if key is not None:
            rows.append((*key, state.hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], [*_KEY, "ends_sha256"])

    keys = ", ".join(f"{k} bigint" for k in _KEY)
    dealt = ends.select(*_KEY, "_c").repartitionByRange("_c").sortWithinPartitions(*_KEY, "_c")
    parts = dealt.mapInArrow(chunks, f"{keys}, _first bigint, _ids string")
    parts = parts.repartition(*_KEY).sortWithinPartitions(*_KEY, "_first").select(*_KEY, "_ids")
    return parts.mapInArrow(hashes, f"{keys}, ends_sha256 string")


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of conversations given as numbered turns with a row at position 0 for each conversation.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256); see the module for their meaning.
    """
    rows = written(_hashed(rows), "trie-rows")
    whole = rows.groupBy("_c").agg(*[F.sum(k).alias(k) for k in _KEY], F.max("_p").alias("_len"), F.sum("_w").alias("_all"))
    whole = written(whole, "trie-whole")
    sequences = whole.groupBy(*_KEY, "_len").agg(F.count(F.lit(1)).alias("_weight"), F.min("_c").alias("_rep"), F.min("_all").alias("_all"))
    sequences = written(sequences, "trie-sequences")
    prefixes = _prefixes(rows, sequences)
    proper = prefixes.where("_depth < _len").select(*_as(_KEY, "_q"), F.col("_depth").alias("_qd")).distinct()
    leaves = sequences.join(proper, _same([*_KEY, "_len"], [*["_q" + k for k in _KEY], "_qd"]), "left_anti").select(F.col("_rep").alias("_leaf"))
    # the smallest leaf below a node owns it; its part of the path begins at the least _before of what it owns
    owned = prefixes.join(leaves, F.col("_rep") == F.col("_leaf")).groupBy(*_KEY, "_depth").agg(F.min("_rep").alias("_owner"), F.min("_before").alias("_before"))
    owned = owned.groupBy("_owner").agg(F.min("_before").alias("_from"))
    d = prefixes.join(owned, F.col("_rep") == F.col("_owner"), "left")
    saved = F.col("_weight") * (F.col("_all") - F.col("_before")) - F.when(F.col("_owner").isNotNull(), F.col("_all") - F.greatest("_from", "_before")).otherwise(0)
    nodes = d.groupBy(*_KEY, "_depth").agg(
        F.min("_rep").alias("conv_id"), F.sum("_weight").alias("n_convs"), F.count("_owner").alias("n_leaves"), F.sum(saved).alias("saved_tokens"),
        *[F.min("_up" + k).alias("_up" + k) for k in _KEY])
    nodes = written(nodes, "trie-nodes")
    up = ["_up" + k for k in _KEY]
    children = nodes.where("_depth > 0").groupBy(*up, (F.col("_depth") - 1).alias("_cd")).agg(F.count(F.lit(1)).alias("n_children"))
    children = children.withColumnsRenamed({u: "_c" + u for u in up})
    parents = nodes.select(*_as(_KEY, "_p"), (F.col("_depth") + 1).alias("_pd"), F.col("conv_id").alias("parent_conv_id"))
    ends = end_lists(whole).withColumnsRenamed({k: "_e" + k for k in _KEY})
    out = nodes.join(children, _same([*_KEY, "_depth"], [*["_c" + u for u in up], "_cd"]), "left")
    out = out.join(ends, _same(_KEY, ["_e" + k for k in _KEY]), "left")
    out = out.join(parents, _same([*up, "_depth"], [*["_p" + k for k in _KEY], "_pd"]), "left")
    none = F.sha2(F.lit(""), 256)
    return out.select(
        "conv_id", F.col("_depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.col("n_leaves").cast("long").alias("n_leaves"), "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                      rebuild: bool = True) -> DataFrame:
    """The trie of all conversations; with ``rebuild`` after :func:`rebuilt`."""
    rows = numbered(turns_of(conversations, conv_id, turn, role, text))
    if rebuild:
        return trie(rebuilt(rows))
    roots = rows.select("_c").distinct().select("_c", F.lit(0).cast("long").alias("_p"), F.lit(0).alias("_b"),
                                                 F.lit(None).cast("binary").alias("_m"), F.lit(0).cast("long").alias("_w"))
    return trie(rows.unionByName(roots))
