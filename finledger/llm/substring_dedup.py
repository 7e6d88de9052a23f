"""Substring dedup: count-min prefilter, then an exact second pass.

A window is ``window`` consecutive words of one document. Every word covered
by a window whose word sequence also starts in a document with a smaller id is
removed.

Documents are dealt to *units* by ranges of doc_id (cut points are quantiles
of the ids), so all ids of an earlier unit are smaller than those of a later
one. An id that several cut points fall on (a null id of many rows) has as many units
to itself; they count as equally early. Three passes run over the units; the dealt documents are one exchange
that all three reuse:

1. **Sketch.** Each unit builds a count-min sketch of its windows: ``depth``
   rows of counters, width 8 or more counters for each window of the corpus. The sketch is
   sparse, so its non-zero counters travel as sorted, gap-coded cells, split
   into blocks of the counter space. Merging a block sums the units' counters;
   a counter of 2 or more means "may be repeated". The answer to each unit is
   one bit for each cell it sent, so no sketch is ever broadcast or held
   whole, and its width may follow the corpus.
2. **Exact grouping.** Only windows whose estimate (the minimum over the rows) is 2
   or more are grouped, by 96 bits of their word sequence. Estimates never
   fall short, so no repeated window is lost. The answer is one bit: does
   an earlier unit hold the same sequence?
3. **Removal.** A window is covered if an earlier unit holds it, or an earlier
   document of its own unit.

Units and blocks both number about the square root of the work, so what a
task holds and the number of (unit, block) messages grow alike. A sequence
that a third of all documents share is one entry for each unit, never one for each row.

Beyond ``DIRECT_UNITS`` units (some 256 GB of text) messages go by way of *groups*. A unit
sends wide blocks, about the square root of the blocks. A group of about the square root of the units
merges what its units send about a wide block, asks the blocks in it as if it were one unit,
and answers its units. So messages grow with the power 1.5 of the units, not 2; the answers
are the same bits.

Defined cases: null and empty texts have no words (kept text empty); a text
shorter than the window is kept whole; null ids sort last and count as one id; rows of one id, however many, are never removed
against each other; an empty table gives an empty result; other columns, whatever their names, pass
through (an added name that is taken gets a leading underscore).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finledger.llm._common import free_name, text_or_empty, written

WINDOW = 13
DEPTH = 2
DIRECT_UNITS = 4096  # more units than that send by way of groups
_WORD = 6            # a rough word length in bytes, to size the sketch
_NULL_ID = (1 << 63) - 1
_M1, _M2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def _unit_bytes(total: int) -> int:
    """Text of one unit: grows with the square root, 256 KB at least and 64 MB at most."""
    return min(64 << 20, max(256 << 10, math.isqrt(max(0, total)) * 32))


# ------------------------------------------------------------------ inside tasks


def _mixed(a):
    import numpy as np

    a = (a ^ (a >> np.uint64(33))) * np.uint64(_MIX[0])
    a = (a ^ (a >> np.uint64(33))) * np.uint64(_MIX[1])
    return a ^ (a >> np.uint64(33))


def _windows(texts, window: int):
    """Of a unit's texts: start of each document in the unit's words, the windows' first words, and two 64-bit keys."""
    import numpy as np
    from xxhash import xxh3_128_digest

    starts, digests = [0], []
    for t in texts:
        w = (t or "").encode("utf-8", "surrogatepass").split()
        digests.append(b"".join(map(xxh3_128_digest, w)))
        starts.append(starts[-1] + len(w))
    starts = np.asarray(starts, dtype=np.int64)
    a = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
    n = len(a) - window + 1
    if n <= 0:
        e = np.empty(0, dtype=np.uint64)
        return starts, np.empty(0, dtype=np.int64), e, e
    k1, k2 = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    for j in range(window):
        k1 = k1 * np.uint64(_M1) + a[j:j + n, 0]
        k2 = k2 * np.uint64(_M2) + a[j:j + n, 1]
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    inside = np.flatnonzero(doc[:n] == doc[window - 1:])
    return starts, inside, _mixed(k1[inside]), _mixed(k2[inside])


def _cells(k1, row: int, bits: int):
    import numpy as np

    return _mixed(k1 + np.uint64((row * _M2 + row) % (1 << 64))) >> np.uint64(64 - bits)


def _gaps(cells) -> bytes:
    """Sorted distinct numbers as 16-bit gaps; 65535 adds to the next gap."""
    import numpy as np

    d = np.diff(cells.astype(np.int64), prepend=-1) - 1
    whole, rest = d // 65535, d % 65535
    at = np.cumsum(whole + 1) - 1
    out = np.full(at[-1] + 1 if len(at) else 0, 65535, dtype="<u2")
    out[at] = rest
    return out.tobytes()


def _from_gaps(data: bytes):
    import numpy as np

    x = np.frombuffer(data, dtype="<u2").astype(np.int64)
    end = x != 65535
    return (np.cumsum(x)[end] + np.arange(end.sum())).astype(np.int64)


def _blocks(sorted_values, shift: int):
    """(block, from, to) of the runs of sorted values with equal high bits."""
    import numpy as np

    high = (sorted_values >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(sorted_values), dtype=np.int64)
    cut = np.flatnonzero(np.diff(high)) + 1
    edges = [0, *cut.tolist(), len(high)]
    return [(int(high[i]), i, j) for i, j in zip(edges, edges[1:]) if j > i]


def _sketch_rows(k1, plan):
    """For each row and block of the sketch: (row, block, sorted cells, indices of their windows' cells, counter > 1)."""
    import numpy as np

    for row in range(plan["depth"]):
        cells, back, count = np.unique(_cells(k1, row, plan["bits"]), return_inverse=True, return_counts=True)
        yield row, cells, back, count > 1


def _estimated(k1, unit_rows, plan):
    """Which windows of the unit have an estimate of 2 or more, from the answers about its sketch."""
    import numpy as np

    answers = {(k, b): x for k, b, x in unit_rows if k < plan["depth"]}
    may = np.ones(len(k1), dtype=bool)
    for row, cells, back, _ in _sketch_rows(k1, plan):
        bits = np.zeros(len(cells), dtype=bool)
        for b, i, j in _blocks(cells, plan["bits"] - plan["wide_bits"]):
            bits[i:j] = np.unpackbits(np.frombuffer(answers[row, b], dtype=np.uint8), count=j - i).astype(bool)
        may &= bits[back]
    return may


def _candidates(k1, k2, may):
    """Distinct sequences of the candidate windows, sorted: keys and, for each candidate window, the index of its key."""
    import numpy as np

    keys = np.zeros(int(may.sum()), dtype=[("a", "<u8"), ("b", "<u4")])
    keys["a"], keys["b"] = k1[may], (k2[may] >> np.uint64(32)).astype("<u4")
    order = np.lexsort((keys["b"], keys["a"]))
    s = keys[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    back = np.empty(len(s), dtype=np.int64)
    back[order] = np.cumsum(new) - 1
    return s[new], back


def _table(rows, names, types):
    import pyarrow as pa

    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table([pa.array(list(c), t) for c, t in zip(cols, types)], names=names)


def _message(rows):
    import pyarrow as pa

    return _table(rows, ["kind", "block", "unit", "data"], [pa.int32(), pa.int64(), pa.int64(), pa.binary()])


MESSAGE = "kind int, block bigint, unit bigint, data binary"


def _sketch(plan):
    def run(t):
        import numpy as np

        unit = t["_unit"][0].as_py()
        _, _, k1, _ = _windows(t["_text"].to_pylist(), plan["window"])
        rows, shift = [], plan["bits"] - plan["wide_bits"]
        for row, cells, _, many in _sketch_rows(k1, plan):
            for b, i, j in _blocks(cells, shift):
                own = cells[i:j] - np.uint64(b << shift)
                rows.append((row, b, unit, _sketch_data(own, many[i:j])))
        return _message(rows)
    return run


def _sketch_data(cells, many) -> bytes:
    import numpy as np

    return _gaps(cells) + np.packbits(many).tobytes() + len(cells).to_bytes(4, "little")


def _summed(messages):
    """Of several sketches: the cells of each, all distinct cells, each cell's place among them, and whether their counters sum to 2 or more."""
    import numpy as np

    cells, many = [], []
    for x in messages:
        n = int.from_bytes(x[-4:], "little")
        flags = (n + 7) // 8
        cells.append(_from_gaps(x[:-4 - flags]))
        many.append(np.unpackbits(np.frombuffer(x[-4 - flags:-4], dtype=np.uint8), count=n))
    distinct, back, count = np.unique(np.concatenate(cells), return_inverse=True, return_counts=True)
    count = count + np.bincount(back, weights=np.concatenate(many), minlength=len(count))
    return cells, distinct, back, count > 1


def _split_bits(kind, block, units, sizes, bits):
    """Bits about the cells or keys of several units, one message for each unit."""
    import numpy as np

    at, rows = 0, []
    for unit, n in zip(units, sizes):
        rows.append((kind, block, unit, np.packbits(bits[at:at + n]).tobytes()))
        at += n
    return _message(rows)


def _merge_sketches(t):
    """One block of one sketch row: sums the units' counters and answers each unit with a bit for each of its cells."""
    cells, _, back, many = _summed(t["data"].to_pylist())
    return _split_bits(t["kind"][0].as_py(), t["block"][0].as_py(), t["unit"].to_pylist(), map(len, cells), many[back])


def _group_sketch(plan):
    def run(t):
        """One wide block of the units of a group: their merged sketch, cut into blocks, with the group as unit."""
        import numpy as np

        kind, wide, group = (t[c][0].as_py() for c in ("kind", "block", "_group"))
        _, cells, _, many = _summed(t["data"].to_pylist())
        shift, rows = plan["bits"] - plan["block_bits"], []
        for b, i, j in _blocks(cells.astype(np.uint64), shift):
            rows.append((kind, (wide << plan["more_bits"]) + b, group, _sketch_data(cells[i:j] - (b << shift), many[i:j])))
        return _message(rows)
    return run


def _group_bits(answers, size):
    """The bits that a group got about its cells or keys: those of its blocks in order, each as long as ``size`` says."""
    import numpy as np

    got = sorted(zip(answers["block"].to_pylist(), answers["data"].to_pylist()))
    return np.concatenate([np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=size(b)).astype(bool) for b, x in got])


def _group_sketch_answers(plan):
    def run(t, answers):
        """One wide block of a group: the blocks' answers about its merged cells, handed on to its units."""
        import numpy as np

        kind, wide = t["kind"][0].as_py(), t["block"][0].as_py()
        cells, distinct, back, _ = _summed(t["data"].to_pylist())
        of = np.bincount(distinct >> (plan["bits"] - plan["block_bits"]), minlength=1 << plan["more_bits"])
        hit = _group_bits(answers, lambda b: int(of[b - (wide << plan["more_bits"])]))
        return _split_bits(kind, wide, t["unit"].to_pylist(), map(len, cells), hit[back])
    return run


def _unit_answers(t):
    return list(zip(t["kind"].to_pylist(), t["block"].to_pylist(), t["data"].to_pylist()))


def _request(plan):
    def run(docs, answers):
        if not docs.num_rows:
            return _message([])
        unit = docs["_unit"][0].as_py()
        _, _, k1, k2 = _windows(docs["_text"].to_pylist(), plan["window"])
        keys, _ = _candidates(k1, k2, _estimated(k1, _unit_answers(answers), plan))
        rows = []
        for b, i, j in _blocks(keys["a"], 64 - plan["wide_bits"]):
            rows.append((plan["depth"], b, unit, keys["a"][i:j].tobytes() + keys["b"][i:j].tobytes()))
        return _message(rows)
    return run


def _asked(messages, orders=None):
    """Of several lists of keys: their lengths, all distinct keys (a, b), each key's place among them, its order, the least order of each.

    A unit's list has one order for all its keys; a group's list says each key's own.
    """
    import numpy as np

    sizes = [len(x) // (12 if orders is not None else 20) for x in messages]
    a = np.concatenate([np.frombuffer(x, dtype="<u8", count=n) for x, n in zip(messages, sizes)])
    b = np.concatenate([np.frombuffer(x, dtype="<u4", offset=8 * n, count=n) for x, n in zip(messages, sizes)])
    if orders is not None:
        order = np.repeat(np.asarray(orders, dtype=np.int64), sizes)
    else:
        order = np.concatenate([np.frombuffer(x, dtype="<i8", offset=12 * n, count=n) for x, n in zip(messages, sizes)])
    by = np.lexsort((order, b, a))
    sa, sb = a[by], b[by]
    first = np.ones(len(by), dtype=bool)
    first[1:] = (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])
    back = np.empty(len(by), dtype=np.int64)
    back[by] = np.cumsum(first) - 1
    return sizes, (sa[first], sb[first]), back, order, order[by][first]


def _unit_orders(t, plan):
    return [u // plan["units"] for u in t["unit"].to_pylist()]


def _earlier_units(plan):
    def run(t):
        """One block of exact keys: a bit for each key of a unit (or group), set if one of smaller ids has it too."""
        orders = None if plan["more_bits"] else _unit_orders(t, plan)
        sizes, _, back, order, least = _asked(t["data"].to_pylist(), orders)
        return _split_bits(t["kind"][0].as_py(), t["block"][0].as_py(), t["unit"].to_pylist(), sizes, order > least[back])
    return run


def _group_keys(plan):
    def run(t):
        """One wide block of the units of a group: their distinct keys with the least order of each, cut into blocks."""
        kind, wide, group = (t[c][0].as_py() for c in ("kind", "block", "_group"))
        _, (ka, kb), _, _, least = _asked(t["data"].to_pylist(), _unit_orders(t, plan))
        rows = []
        for b, i, j in _blocks(ka, 64 - plan["block_bits"]):
            rows.append((kind, b, group, ka[i:j].tobytes() + kb[i:j].tobytes() + least[i:j].tobytes()))
        return _message(rows)
    return run


def _group_key_answers(plan):
    def run(t, answers):
        """One wide block of a group: a unit's key is held earlier by another group, or by an earlier unit of its own."""
        import numpy as np

        kind, wide = t["kind"][0].as_py(), t["block"][0].as_py()
        sizes, (ka, _), back, order, least = _asked(t["data"].to_pylist(), _unit_orders(t, plan))
        of = {b: j - i for b, i, j in _blocks(ka, 64 - plan["block_bits"])}
        earlier = _group_bits(answers, of.__getitem__)
        return _split_bits(kind, wide, t["unit"].to_pylist(), sizes, earlier[back] | (order > least[back]))
    return run


def _remove(plan, names):
    def run(docs, answers):
        import numpy as np
        import pyarrow as pa

        if not docs.num_rows:
            docs = docs.select(names)
            return docs.append_column("n_words", pa.array([], pa.int64())).append_column("n_removed", pa.array([], pa.int64())).append_column("kept_text", pa.array([], pa.string()))
        texts, window = docs["_text"].to_pylist(), plan["window"]
        starts, first, k1, k2 = _windows(texts, window)
        own = _unit_answers(answers)
        may = _estimated(k1, own, plan)
        keys, back = _candidates(k1, k2, may)
        later = np.zeros(len(keys), dtype=bool)
        said = {b: x for k, b, x in own if k == plan["depth"]}
        for b, i, j in _blocks(keys["a"], 64 - plan["wide_bits"]):
            later[i:j] = np.unpackbits(np.frombuffer(said[b], dtype=np.uint8), count=j - i).astype(bool)
        # within the unit: the smallest id that starts each sequence
        ids = np.asarray([_NULL_ID if x is None else x for x in docs["_id"].to_pylist()], dtype=np.int64)
        at = first[may]
        id_of = ids[np.searchsorted(starts, at, side="right") - 1]
        least = np.full(len(keys), _NULL_ID, dtype=np.int64)
        np.minimum.at(least, back, id_of)
        gone = at[later[back] | (least[back] < id_of)]
        cover = np.zeros(int(starts[-1]) + 1, dtype=np.int64)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + window, -1)
        out = np.cumsum(cover[:-1]) > 0
        kept, removed = [], []
        for t, i, j in zip(texts, starts[:-1].tolist(), starts[1:].tolist()):
            w, o = (t or "").encode("utf-8", "surrogatepass").split(), out[i:j]
            removed.append(int(o.sum()))
            kept.append(b" ".join([x for x, g in zip(w, o.tolist()) if not g] if removed[-1] else w).decode("utf-8", "surrogatepass"))
        done = docs.select(names)
        for name, col in (("n_words", pa.array(np.diff(starts), pa.int64())), ("n_removed", pa.array(removed, pa.int64())), ("kept_text", pa.array(kept, pa.string()))):
            done = done.append_column(name, col)
        return done
    return run


# ------------------------------------------------------------------ on the session


def _exchange(messages: DataFrame, plan: dict, block, group, group_answers) -> DataFrame:
    """Messages of units to blocks and the blocks' answers back, by way of groups if there are wide blocks."""
    if not plan["more_bits"]:
        return messages.groupBy("kind", "block").applyInArrow(block, MESSAGE)
    sent = messages.withColumn("_group", F.pmod(F.xxhash64("unit"), F.lit(1 << plan["wide_bits"])))
    answered = sent.groupBy("kind", "block", "_group").applyInArrow(group, MESSAGE).groupBy("kind", "block").applyInArrow(block, MESSAGE)
    back = answered.select("*", F.shiftright("block", plan["more_bits"]).alias("_wide")).groupBy("kind", "_wide", "unit")
    return sent.groupBy("kind", "block", "_group").cogroup(back).applyInArrow(group_answers, MESSAGE)


def deal(rows: DataFrame, units: int) -> DataFrame:
    """Adds ``_unit``: the place of ``_id`` among the cut points times ``units``, plus the part among the units of one id.

    The rows of an id on several cut points are spread by a row number. Then the dealt rows
    are written, so that a repeated task cannot deal them otherwise.
    """
    from pyspark.sql.functions import pandas_udf

    key, cuts = F.coalesce("_id", F.lit(_NULL_ID)), []
    if units > 1:
        share = [i / units for i in range(1, units)]
        cuts = rows.agg(F.percentile_approx(key, share, max(10_000, 10 * units)).alias("q")).first()["q"] or []

    @pandas_udf("bigint")
    def unit_of(ids, row):
        import numpy as np
        import pandas as pd

        points, ids = np.asarray(cuts, dtype=np.int64), ids.to_numpy()
        place = np.searchsorted(points, ids, side="left")
        own = np.searchsorted(points, ids, side="right") - place - 1  # smaller ids may lie in the first
        part = np.where(own > 0, row.to_numpy() % np.maximum(own, 1), 0)
        return pd.Series((place + (own > 0)) * units + part)

    if len(set(cuts)) == len(cuts):
        return rows.withColumn("_unit", unit_of(key, F.lit(0).cast("bigint")))
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    return written(numbered.withColumn("_unit", unit_of(key, "_row")).drop("_row"), "substring-units")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
                   depth: int = DEPTH, keep: list[str] | None = None, direct_units: int = DIRECT_UNITS) -> DataFrame:
    """The input's columns (or those in ``keep``) with n_words, n_removed and kept_text (kept words joined by one space).

    ``doc_id`` is a long.
    """
    keep = docs.columns if keep is None else keep
    sizes = docs.agg(F.sum(F.octet_length(text_or_empty(text))).alias("b"), F.count(F.lit(1)).alias("n")).first()
    total, n = sizes["b"] or 0, sizes["n"]
    units = max(1, min(n, -(-total // _unit_bytes(total))))
    block_bits = max(0, units.bit_length() - 1)
    wide_bits = block_bits if units <= direct_units else block_bits // 2
    plan = {"window": window, "depth": depth, "units": units, "block_bits": block_bits,
            "wide_bits": wide_bits, "more_bits": block_bits - wide_bits,
            "bits": min(62, max(block_bits + 8, (8 * max(1, total // _WORD)).bit_length()))}
    # the text travels once, under its own name; other columns by their place, so no name can clash
    names = ["_text" if c == text else f"_c{i}" for i, c in enumerate(keep)]
    passed = [F.col(f"`{c}`").alias(name) for c, name in zip(keep, names) if name != "_text"]
    dealt = deal(docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("_text"), *passed), units)

    by_unit = dealt.groupBy("_unit")
    sketches = by_unit.applyInArrow(_sketch(plan), MESSAGE)
    repeated = _exchange(sketches, plan, _merge_sketches, _group_sketch(plan), _group_sketch_answers(plan))
    asked = by_unit.cogroup(repeated.withColumnRenamed("unit", "_unit").groupBy("_unit")).applyInArrow(_request(plan), MESSAGE)
    earlier = _exchange(asked, plan, _earlier_units(plan), _group_keys(plan), _group_key_answers(plan))
    answers = repeated.union(earlier).withColumnRenamed("unit", "_unit")
    schema = T.StructType([T.StructField(name, docs.schema[c].dataType) for c, name in zip(keep, names)]
                          + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    done = by_unit.cogroup(answers.groupBy("_unit")).applyInArrow(_remove(plan, names), schema)
    return done.select(*[F.col(name).alias(c) for c, name in zip(keep, names)],
                       *[F.col(c).alias(free_name(c, keep)) for c in ("n_words", "n_removed", "kept_text")])
