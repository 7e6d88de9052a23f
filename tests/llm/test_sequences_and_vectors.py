"""Conversation trie, embedding whitening and piece encoding against brute force, the library and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from finledger.llm import conversation_trie as ct
from finledger.llm import piece_encoding as pe
from finledger.llm import queries, whitening
from finledger.llm._common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# ---------------------------------------------------------------- conversations


def rebuilt_by_hand(rows, rebuild=True):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t, r or "", x or ""))
    own = {c: [(r, x) for t, r, x in sorted(v, key=lambda y: (y[0] is not None, y[0] or 0, hashlib.md5(f"{len(y[1].encode())}:{y[1]}{y[2]}".encode()).digest()))]
           for c, v in own.items()}
    if not rebuild:
        return own
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:]
    return out


def trie_by_hand(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for node, m in members.items():
        s = (len(m) - 1) * len(WORD.findall(node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += s
            leaves[node[:d]] += not kids[node]
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if len(convs[c]) == len(n)))).encode()).hexdigest())
                  for n, m in members.items()) if convs else []


def as_rows(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_trie_of_the_table(spark):
    rows = [tuple(r) for r in table(spark, SF_SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert as_rows(queries.QUERIES["op11_conversation_trie"](spark, SF_SMALL)) == trie_by_hand(rebuilt_by_hand(rows))


def odd_conversations(seed):
    rng = random.Random(seed)
    said = ["", None, "yes", "no it  is", "a\tb c", " ", "x " * 2000]
    rows = []
    for c in [*range(60), 100, 119, 200, -3, -20, 1 << 40, None]:
        if c == 40:
            continue           # an absent first conversation
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([t, t, None, 1]), rng.choice(["user", None, "", "assistant"]), rng.choice(said)))
    return rows + rows[:5]


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("rebuild", [True, False])
def test_trie_of_odd_rows(spark, rebuild):
    rows = odd_conversations(3)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"_c": F.lit("own"), "_p": F.lit(1), "depth": F.lit("x"), "_k0": F.lit(None)})
    assert as_rows(ct.conversation_trie(df, rebuild=rebuild)) == trie_by_hand(rebuilt_by_hand(rows, rebuild))


def test_trie_of_one_long_conversation_in_many_ranges(spark):
    """A conversation of a third of all turns, all turns of another equal, and one sequence that many share."""
    rows = [(7, i, "user", f"turn {i % 50}") for i in range(600)] + [(8, None, "user", "same")] * 300
    rows += [(c, i, "user", f"hello {i}") for c in range(1000, 1200) for i in range(4)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        numbered = ct.numbered(ct.turns_of(df))
        assert numbered.where("_c = 7").agg(F.max("_b")).first()[0] > 0 and numbered.where("_c = 8").agg(F.max("_b")).first()[0] > 0
        assert numbered.groupBy("_c", "_b").count().agg(F.max("count")).first()[0] < 700
        assert as_rows(ct.conversation_trie(df)) == trie_by_hand(rebuilt_by_hand(rows))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_trie_end_lists_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(ct, "_CHUNK", 20)
    ids = [*range(-50, 400), 10 ** 12]
    df = spark.createDataFrame([(c, 1, 2, 3, c % 3) for c in ids], "_c long, _k0 long, _k1 long, _k2 long, _k3 long")
    got = {r["_k3"]: r["ends_sha256"] for r in ct.end_lists(df).collect()}
    want = {k: hashlib.sha256(",".join(str(c) for c in sorted(ids) if c % 3 == k).encode()).hexdigest() for k in range(3)}
    assert got == want


def test_trie_of_nothing(spark):
    assert as_rows(ct.conversation_trie(spark.createDataFrame([], SCHEMA))) == []
    assert as_rows(ct.conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA))) == []


# ---------------------------------------------------------------- embeddings


def whitening_by_hand(vectors, weights=None):
    """Exact sums and covariance as fractions, eigenvectors in doubles."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    cov = np.array([[float(Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n ** 3)) for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[:8]
    y = np.array([[float(Fraction(n * r[i] - s[i], n)) for i in range(d)] for r in x])
    return [sum((n * a - b) ** 2 for a, b in zip(r, s)) for r in x], y @ axes[:, order] / np.sqrt(values[order]), values[order] / cov.trace()


def check_whitened(out, vectors):
    deviation, white, explained = whitening_by_hand(list(vectors.values()))
    got = defaultdict(dict)
    for r in out:
        got[r["vec_id"]][r["component"]] = r
    assert set(got) == set(vectors)
    for k in range(1, white.shape[1] + 1):
        ours = np.array([got[v][k]["whitened"] for v in vectors])
        sign = np.sign(ours @ white[:, k - 1])
        assert np.abs(ours * sign - white[:, k - 1]).max() < 1e-6
        first = got[next(iter(vectors))][k]
        assert math.isclose(first["explained"], explained[k - 1], rel_tol=1e-9) and first["identity_error"] < 1e-9
    assert [got[v][1]["deviation"] for v in vectors] == deviation and {r["n"] for r in out} == {len(vectors)}


def test_whitening_of_the_table(spark):
    rows = table(spark, SF_SMALL, "embeddings").collect()
    out = queries.QUERIES["op12_embedding_whitening"](spark, SF_SMALL).collect()
    check_whitened(out, {r["vec_id"]: r["embedding"] for r in rows})


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")


def test_whitening_of_copies_and_odd_rows(spark):
    rng = random.Random(5)
    base = [[float(np.float32(rng.gauss(0, 0.2))) for _ in range(10)] for _ in range(40)]
    rows = [(i, base[i % 40] if i % 3 else base[0]) for i in range(200)]
    bad = [(900, None), (901, [1.0] * 9 + [None]), (902, [1.0] * 9 + [math.nan]), (903, [math.inf] + [0.0] * 9), (904, []), (905, [0.5] * 3)]
    df = vectors_of(spark, rows + bad).withColumns({"component": F.lit("own"), "_row": F.lit(2), "_x": F.lit(3), "x": F.lit(4), "m": F.lit(5)})
    out = whitening.whiten(df).withColumnRenamed("component", "theirs").withColumnRenamed("_component", "component")
    assert set(out.columns) >= {"vec_id", "theirs", "_row", "_x", "x", "m", *whitening.ADDED}
    check_whitened(out.collect(), dict(rows))


def test_whitening_weighs_by_one(spark):
    rows = [(i, [float(i % 5), float(i % 3), 1.0 if i % 15 else 0.0]) for i in range(90)]
    out = whitening.whiten(vectors_of(spark, rows), weighted=False).collect()
    distinct = {tuple(v): i for i, v in rows}
    deviation, white, explained = whitening_by_hand(list(distinct))
    ours = {(tuple(dict(rows)[r["vec_id"]]), r["component"]): r for r in out}
    for k in (1, 2, 3):
        a = np.array([ours[v, k]["whitened"] for v in distinct])
        assert np.abs(np.abs(a) - np.abs(white[:, k - 1])).max() < 1e-6 and ours[next(iter(distinct)), k]["n"] == len(distinct)


def test_whitening_without_variance_or_rows(spark):
    assert whitening.whiten(vectors_of(spark, [])).collect() == []
    assert whitening.whiten(vectors_of(spark, [(1, None), (2, []), (3, [math.nan])])).collect() == []
    same = whitening.whiten(vectors_of(spark, [(1, [0.5, 0.25]), (1, [0.5, 0.25]), (None, [0.5, 0.25])])).collect()
    assert len(same) == 6 and {(r["whitened"], r["explained"], r["identity_error"], r["deviation"], r["n"]) for r in same} == {(None, None, None, 0, 3)}
    flat = whitening.whiten(vectors_of(spark, [(i, [float(i), 2.0]) for i in range(4)])).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) and r["identity_error"] < 1e-9 for r in flat)


def test_whitening_of_huge_entries(spark):
    rows = [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])]
    out = whitening.whiten(vectors_of(spark, rows)).collect()
    assert len(out) == 6 and any(r["deviation"] is None for r in out)


# ---------------------------------------------------------------- piece encoding

ODD_TEXTS = ["", " ", "   ", " " * 1000, "\t\n\r \r\n", "a\x00b", "日本語😀ﬁ①é é", "▁x▁▁ y▁", "\r", "﻿�", " \r \n  ",
             " " * 37 + "a" + " " * 5, "a" * 5000, "abc" * 3000, "<0x41></s> <unk>", "ab " * 20_000, "日本" * 5000, "=" * 777 + "\n" * 333]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pe.model_path())


@pytest.fixture(scope="module")
def pieces():
    return pe.Pieces(pe.model_path())


def test_pieces_equal_the_library(library, pieces):
    rng = random.Random(11)
    known = list(pieces.ids)
    texts = [*ODD_TEXTS]
    texts += ["".join(rng.choice(" ▁abcdethin\t\n日é\r😀.,<>x0_/-") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    texts += ["".join(rng.choice(known).replace("▁", rng.choice(" ▁")) for _ in range(rng.randint(1, 6))) for _ in range(3000)]
    for whole in (False, True):
        pieces.in_words = not whole
        for t in texts[:None if not whole else 1000]:
            ids = np.frombuffer(pieces.encode(t), dtype=pieces.code).tolist()
            assert ids == library.encode(t), t[:100]
            assert pieces.decode([*ids, pieces.end]) == library.decode([*ids, pieces.end]), t[:100]
    pieces.in_words = True


def test_backtracking_gives_plain_merging(pieces):
    rng = random.Random(13)
    for _ in range(2000):
        t = "".join(rng.choice("▁ethainrso") for _ in range(rng.randint(1, 25)))
        assert [pieces.text_of[i] for i in pieces.split(t)] == pieces.merged(t)


def test_decoding_any_ids_equals_the_library(library, pieces):
    rng = random.Random(17)
    for _ in range(5000):
        ids = [rng.randrange(32_000) if rng.random() < 0.6 else rng.randrange(259) for _ in range(rng.randint(1, 6))]
        assert pieces.decode(ids) == library.decode(ids), ids


def test_bounded_memories(library, monkeypatch):
    monkeypatch.setattr(pe, "_WORDS", 6)
    monkeypatch.setattr(pe, "_PAIRS", 5)
    pieces = pe.Pieces(pe.model_path())
    text = "the bounded memory is cleared again and again without a change of any id"
    assert np.frombuffer(pieces.encode(text), dtype=pieces.code).tolist() == library.encode(text) and len(pieces.words) + len(pieces.older_words) <= 6 and pieces.n_pairs <= 5


def test_piece_query_and_odd_rows(spark, library):
    for r, d in zip(queries.QUERIES["op13_piece_encoding"](spark, SF_SMALL).orderBy("doc_id").collect(),
                    table(spark, SF_SMALL, "documents").orderBy("doc_id").collect()):
        ids = library.encode(d["text"] or "", add_eos=True)
        assert r["doc_id"] == d["doc_id"] and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_piece_columns(spark, library):
    rows = [(i, t) for i, t in enumerate([None, *ODD_TEXTS, ODD_TEXTS[3]])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"ids": F.lit("own"), "c0": F.lit(7), "added": F.lit(8)})
    out = pe.decode(pe.encode(df), "_ids").collect()
    assert len(out) == len(rows) and all(r["ids"] == "own" and r["c0"] == 7 and r["added"] == 8 for r in out)
    for r in out:
        assert r["_ids"] == library.encode(r["text"] or "", add_eos=True) and r["decoded"] == (r["text"] or "").replace("▁", " ")
    assert pe.decode(spark.createDataFrame([(1, None)], "doc_id int, ids array<int>")).first()["decoded"] is None
    assert pe.encode(df.limit(0)).count() == 0
