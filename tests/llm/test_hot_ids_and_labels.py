"""Null and repeated ids, conflicting and rare labels, documents of very many frequent lines."""

import time

from pyspark.sql import functions as F

from finledger.llm import packing, quality_classifier, quality_rules, sharding, substring_dedup, url_filter
from finledger.llm._common import buckets_for, with_uniform

N = 6000


def largest_share(rows, n, keys, row):
    """Rows of the fullest of the buckets that ranked() cuts, against an even share."""
    b = F.floor(F.col("_u") * buckets_for(n))
    return with_uniform(rows, n, 7, keys, row).groupBy(b).count().agg(F.max("count")).first()[0] / (n / buckets_for(n))


def hot_docs(spark):
    """A third of the ids null, a third one repeated row."""
    i = F.col("id")
    return spark.range(N).select(
        F.when(i % 3 == 1, F.lit(5)).when(i % 3 == 2, i).cast("long").alias("doc_id"),
        F.when(i % 3 == 1, F.lit("the same text")).when(i % 6 == 0, F.lit("no id, same text")).otherwise(F.concat(F.lit("text "), i)).alias("text"),
        F.lit("web").alias("source"))


def test_sharding_spreads_null_and_repeated_ids(spark):
    docs = hot_docs(spark)
    rows = sharding.written(sharding.narrow_rows(docs), "test-rows")
    assert largest_share(rows, N, ["_id", "_tie"], "_i") < 4
    out = sharding.deal(docs).select("shard", "slot", "position").collect()
    assert sorted(r.position for r in out) == list(range(N))
    assert {sum(r.shard == s for r in out) for s in range(8)} == {N // 8}


def test_packing_spreads_null_and_repeated_ids(spark):
    docs = hot_docs(spark)
    pieces = packing.written(packing._told_apart(packing.cut_pieces(docs)), "test-pieces")
    n = pieces.count()
    assert largest_share(pieces, n, ["_id", "start", "_tie"], "_i") < 6
    out = packing.pack(docs).select("sequence_id").collect()
    assert sorted(r.sequence_id for r in out) == list(range(n))


def passages(spark, n):
    """A third of the ids null, a third 7; early, own and common passages, some in rows of the hot ids alone."""
    rows = []
    for i in range(n):
        d = None if i % 3 == 0 else 7 if i % 3 == 1 else i % 40
        own = " ".join(f"own{i}x{j}" for j in range(20))
        told = " ".join(f"told{i % 3}x{j}" for j in range(15))
        rows.append((d, "equal in every column " * 4 if i % 5 == 0 else f"{own} {told} {own[:40]}"))
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6), rows


def removed_by_hand(rows, n=13):
    first = {}
    order = {id(r): float("inf") if r[0] is None else r[0] for r in rows}
    cut = [(r, r[1].split()) for r in rows]
    for r, w in cut:
        for j in range(len(w) - n + 1):
            k = tuple(w[j:j + n])
            first[k] = min(first.get(k, float("inf")), order[id(r)])
    out = []
    for r, w in cut:
        gone = {x for j in range(len(w) - n + 1) if first[tuple(w[j:j + n])] < order[id(r)] for x in range(j, j + n)}
        out.append((r[0], len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def test_substring_dedup_spreads_null_and_repeated_ids(spark, monkeypatch):
    docs, rows = passages(spark, 900)
    monkeypatch.setattr(substring_dedup, "_unit_bytes", lambda total: 6_000)
    total = sum(len(t) for _, t in rows)
    units = -(-total // 6_000)
    assert units > 20
    dealt = substring_dedup.deal(docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")), units)
    sizes = dealt.groupBy("_unit").count().collect()
    assert max(r["count"] for r in sizes) < 4 * len(rows) / units
    spread = {d: {r["_unit"] for r in dealt.where(F.col("_id").eqNullSafe(F.lit(d))).select("_unit").distinct().collect()} for d in (None, 7)}
    assert all(len(u) > units / 5 and len({x // units for x in u}) == 1 for u in spread.values())
    out = substring_dedup.remove_repeats(docs, keep=["doc_id"])
    got = sorted(((r.doc_id, r.n_removed, r.kept_text) for r in out.collect()), key=str)
    assert got == removed_by_hand(rows)


def test_substring_dedup_by_way_of_groups(spark, monkeypatch):
    """More units than send directly: the same rows as by hand, and one group's message in place of its units'."""
    docs, rows = passages(spark, 900)
    monkeypatch.setattr(substring_dedup, "_unit_bytes", lambda total: 3_000)
    for direct in (1, 1 << 30):
        out = substring_dedup.remove_repeats(docs, keep=["doc_id"], direct_units=direct)
        assert sorted(((r.doc_id, r.n_removed, r.kept_text) for r in out.collect()), key=str) == removed_by_hand(rows)


def test_groups_answer_as_units_do():
    """Sketches and keys of random units: the answers by way of groups equal the direct ones, bit for bit."""
    import numpy as np
    import pyarrow as pa

    rng, units = np.random.default_rng(5), 40
    windows = [np.unique(np.concatenate([rng.integers(0, 1 << 63, 50), np.arange(9) * (1 << 58) + u % 4])).astype(np.uint64) for u in range(units)]
    plan = {"units": 8, "depth": 1, "bits": 20, "block_bits": 5, "wide_bits": 2, "more_bits": 3}
    direct = {**plan, "wide_bits": 5, "more_bits": 0}

    def cut(plan, of):
        shift = plan["bits"] - plan["wide_bits"] if of == "cells" else 64 - plan["wide_bits"]
        for u, k in enumerate(windows):
            if of == "cells":
                cells, n = np.unique(k >> np.uint64(44), return_counts=True)
                yield from ((0, b, u, substring_dedup._sketch_data(cells[i:j] - np.uint64(b << shift), n[i:j] > 1)) for b, i, j in substring_dedup._blocks(cells, shift))
            else:
                yield from ((1, b, u, k[i:j].tobytes() + np.zeros(j - i, "<u4").tobytes()) for b, i, j in substring_dedup._blocks(k, shift))

    def rows_of(t):
        return list(zip(*[t[c].to_pylist() for c in ("kind", "block", "unit", "data")]))

    def each(messages, run, key=lambda m: m[:2], group=None):
        found = {}
        for m in messages:
            found.setdefault(key(m), []).append(m)
        for k, ms in sorted(found.items()):
            t = substring_dedup._message(ms)
            yield from rows_of(run(t if group is None else t.append_column("_group", pa.array([group(ms[0])] * len(ms)))))

    def whole(answers, plan, of):
        sizes, bits = {(b, u): len(x) // 12 for _, b, u, x in cut(plan, of)}, {}
        for _, b, u, x in sorted(answers):
            n = sizes[b, u] if of == "keys" else int.from_bytes(dict(((b, u), d) for _, b, u, d in cut(plan, of))[b, u][-4:], "little")
            bits.setdefault(u, []).extend(np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=n).tolist())
        return bits

    for of, block, by_group, back in (
            ("cells", lambda p: substring_dedup._merge_sketches, substring_dedup._group_sketch, substring_dedup._group_sketch_answers),
            ("keys", substring_dedup._earlier_units, substring_dedup._group_keys, substring_dedup._group_key_answers)):
        want = whole(each(cut(direct, of), block(direct)), direct, of)
        sent = list(cut(plan, of))
        place = lambda m: (m[0], m[1], m[2] % 4)
        asked = list(each(sent, by_group(plan), place, lambda m: m[2] % 4))
        assert len(asked) < len(list(cut(direct, of))) / 2
        answered = {}
        for m in each(asked, block(plan)):
            answered.setdefault((m[0], m[1] >> 3, m[2]), []).append(m)
        got = []
        for key in sorted({place(m) for m in sent}):
            t = substring_dedup._message([m for m in sent if place(m) == key])
            got += rows_of(back(plan)(t, substring_dedup._message(answered[key])))
        assert whole(got, plan, of) == want and any(any(x) for x in want.values())


def test_substring_dedup_of_one_id_alone(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "_unit_bytes", lambda total: 2_000)
    docs = spark.range(200).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same words again " * 5).alias("text"))
    out = substring_dedup.remove_repeats(docs).collect()
    assert len(out) == 200 and {(r.doc_id, r.n_removed) for r in out} == {(None, 0)}


def test_conflicting_labels_have_one_rule(spark):
    docs = spark.createDataFrame([(i, f"good plain words {i % 7}" if i % 2 else f"spam offer {i % 5}") for i in range(200)], "doc_id long, text string")
    both = [(i, y) for i in range(200) for y in ({i % 2, 1} if i % 4 else {i % 2})]

    def scores(pairs):
        model = quality_classifier.train(docs, spark.createDataFrame(pairs, "doc_id long, quality int"))
        return [r.score for r in quality_classifier.score(docs, model).orderBy("doc_id").collect()]
    assert scores(both) == scores(list(reversed(both))) == scores([(i, min(y for j, y in both if j == i)) for i in range(200)])


def test_a_rare_label_still_makes_trees(spark):
    urls = [(f"http://site{i}.example/{i}", 0) for i in range(3000)] + [(f"http://bad{i}.worse/x?a={i}&b=1", 1) for i in range(3)]
    model = url_filter.train(spark.createDataFrame(urls, "url string, label int"), max_rows=100)
    assert model.trees is not None
    pages = spark.createDataFrame([(1, "http://bad1.worse/x?a=1&b=1"), (2, "http://site5.example/5")], "page_id int, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, model, {}).collect()}
    assert got == {1: "block", 2: "allow"}


def own_words(doc, lines):
    return " ".join(f"{chr(97 + doc)}own{i}" for i in range(lines * 12))


def frequent_docs(spark, lines):
    text = "\n".join(f"frequent line number {i}" for i in range(lines))
    return spark.createDataFrame([(d, f"begin\n{text}\n\n{own_words(d, lines)}\n \nend", "web") for d in range(24)], "doc_id long, text string, source string")


def test_cleaning_costs_what_the_lines_cost(spark):
    def seconds(lines):
        docs = frequent_docs(spark, lines)
        start = time.perf_counter()
        rows = {r.doc_id: r.text for r in quality_rules.clean(docs).collect()}
        taken = time.perf_counter() - start
        assert rows == {d: docs.where(F.col("doc_id") == d).first().text if d == 0 else f"\n{own_words(d, lines)}\n " for d in range(24)}
        return taken
    seconds(500)
    few, many = seconds(1000), seconds(8000)
    assert many < 20 * few       # 64 times, were it the square
