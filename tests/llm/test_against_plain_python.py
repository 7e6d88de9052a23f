"""Fitted weights and sketches against plain Python: the same updates on dictionaries, the same hashes on sets."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh64_intdigest

from conftest import SF_SMALL
from finledger.llm import fingerprints, quality_classifier as qc
from finledger.llm._common import table

MASK = (1 << 64) - 1


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF_SMALL, "documents")


# ---------------------------------------------------------------- quality classifier


def plain_features(text, bits):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    h = [xxh3_64_intdigest(t) for t in re.findall(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x00-\x20\x7f-\xff]+", lower.encode())]
    grams = list(h)
    for a, b in zip(h, h[1:]):
        grams.append(((((a * 0x9E3779B97F4A7C15) & MASK) ^ ((b + 0x632BE59BD9B4E019) & MASK)) * 0xC2B2AE3D27D4EB4F) & MASK)
    for d in (1, 2):
        grams += [(d * 0xD6E8FEB86659FD93) & MASK for a, b in zip(h, h[d:]) if a == b]
    count = Counter(g >> (64 - bits) for g in grams)
    length = math.sqrt(sum(c * c for c in count.values()))
    return {i: c / length for i, c in count.items()}


def plain_ftrl(rows, bits, epochs):
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= qc.L1:
            return 0.0
        return -(z[i] - math.copysign(qc.L1, z[i])) / ((qc.BETA + math.sqrt(n[i])) / qc.ALPHA + qc.L2)

    for _ in range(epochs):
        for x, y in rows:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - y) * x[i]
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / qc.ALPHA * w[i]
                n[i] += g * g
    return {i: weight(i) for i in n}


def test_weights_and_scores_equal_a_plain_ftrl(spark, docs):
    bits, epochs, per_part = 12, 2, 20
    labels = table(spark, SF_SMALL, "labels").select("doc_id", "quality")
    model = qc.train(docs, labels, bits=bits, rows_per_part=per_part, epochs=epochs)
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = {r["doc_id"] for r in docs.where(qc.is_held_out(F.col("doc_id"))).select("doc_id").collect()}
    trained = [d for d in quality if d in texts and d not in held and quality[d] in (0, 1)]
    key = {d: (int(hashlib.md5(f"{qc.SEED}|{d}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52) for d in trained}
    parts = -(-len(trained) // per_part)
    assert parts > 1
    by_part = defaultdict(list)
    for d in sorted(trained, key=key.get):
        by_part[math.floor(key[d] * 1e9) % parts].append(({**plain_features(texts[d], bits), 1 << bits: 1.0}, quality[d]))
    want = defaultdict(float)
    for rows in by_part.values():
        for i, w in plain_ftrl(rows, bits, epochs).items():
            want[i] += w / len(by_part)
    got = qc.averaged(model, bits)
    assert len(want) > 500 and sum(w != 0 for w in want.values()) > 100
    assert all(got[i] == pytest.approx(want.get(i, 0.0), abs=1e-9) for i in range((1 << bits) + 1))
    for r in qc.score(docs, model, bits=bits, keep=["doc_id"]).collect():
        x = {**plain_features(texts[r["doc_id"]], bits), 1 << bits: 1.0}
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-sum(want[i] * v for i, v in x.items()))), abs=1e-9)


# ---------------------------------------------------------------- document fingerprints


def plain_hashes(text, n=fingerprints.SHINGLE):
    """Signed hashes of the distinct shingles: XXH64 word after word, each seeded with the hash before."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    shingles = [w[i:i + n] for i in range(len(w) - n + 1)] if len(w) >= n else [[" ".join(w)]] if w else []
    out = set()
    for s in shingles:
        h = 42
        for x in s:
            h = xxh64_intdigest(x.encode(), seed=h)
        out.add(h - (1 << 64) if h >> 63 else h)
    return out


def test_sketches_equal_the_smallest_hashes(spark, docs):
    edge = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \t"), (-4, "one two"), (-5, "a b c d e"), (-6, "x " * 500), (-7, "été \U0001f600 " * 9)],
                                 "doc_id bigint, text string")
    both = docs.select("doc_id", "text").unionByName(edge)
    for r in fingerprints.with_sketch(both, "text", "s").collect():
        assert r["s"] == sorted(plain_hashes(r["text"]))[:fingerprints.K], r["doc_id"]


def test_estimates_are_near_the_whole_sets(spark, docs):
    """Every document against one that holds a part of it: errors of resemblance, containment and count."""
    d = docs.select("text", F.expr("substring(text, 1, cast(length(text) * (doc_id % 5) / 5 as int))").alias("part"))
    d = fingerprints.with_sketch(fingerprints.with_sketch(d, "text", "a"), "part", "b")
    a, b = F.col("a"), F.col("b")
    rows = d.select("text", "part", fingerprints.resemblance(a, b).alias("j"), fingerprints.containment(a, b).alias("c"),
                    fingerprints.containment(b, a).alias("back"), fingerprints.distinct_shingles(a).alias("n")).collect()
    off = defaultdict(list)
    for r in rows:
        x, y = plain_hashes(r["text"]), plain_hashes(r["part"])
        if not x or not y:
            continue
        wants = {"j": len(x & y) / len(x | y), "c": len(x & y) / len(x), "back": len(x & y) / len(y), "n": 1.0}
        gots = {"j": r["j"], "c": r["c"], "back": r["back"], "n": r["n"] / len(x)}
        small = len(x | y) <= fingerprints.K - 1
        for k, want in wants.items():
            assert not small or gots[k] == pytest.approx(want), (k, r["text"][:50])  # fewer shingles than the sketch holds: exact
            if not small:
                off[k].append(gots[k] - want)
    big = len(off["n"])
    assert big >= 30
    for k, most in {"j": 0.06, "c": 0.1, "back": 0.15, "n": 0.15}.items():
        mean_abs, bias = sum(map(abs, off[k])) / big, abs(sum(off[k])) / big
        assert mean_abs < most and bias < most / 2 + 0.25 / math.sqrt(big), (k, mean_abs, bias)
