"""Quality classifier: hashed word n-gram logistic regression, FTRL-proximal.

Features: A-Z lower-cased runs of word characters and runs of other printable
ASCII characters are tokens; uni- and bigrams, and the abstract n-gram of a word
that repeats itself, are hashed into 2^``bits`` weights; a text's counts are scaled to unit length. Scores are sparse dot
products put through the logistic function. Nothing but the text enters.

Training: follow-the-regularised-leader updates (per-coordinate rates, L1 and
L2) over a bounded sample of labelled rows, ``MAX_TRAIN_ROWS`` by a seeded hash
of the id. The sample is dealt over parts of about ``ROWS_PER_PART`` rows, each a task that runs the updates over
its rows in hash order for ``EPOCHS`` epochs, and the parts' weights are averaged
(a classic parameter mixture). The model has
2^bits weights at most, whatever the corpus, and that bound is what makes it fit to broadcast.

Held out: rows whose crc32 of the id as text leaves 2 modulo 4 are never trained on.

Defined cases: null and empty texts score by the bias alone, like any text without tokens; labels that are
null or of unknown documents are ignored; of two labels of one document the lower one holds; without any label every score is 0.5;
repeated rows are scored each; an empty table gives an empty result; other columns
pass through :func:`score` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finledger.llm._common import LOWER_BYTES, free_name, uniform

BITS = 18
MAX_TRAIN_ROWS = 20_000
ROWS_PER_PART = 2_000
EPOCHS = 3
SEED = 5
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
THRESHOLD = 0.7


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def features(text: str | None, bits: int):
    """(indices, values) of a text: sorted distinct hashed n-grams and their unit-length counts."""
    import re

    import numpy as np
    from xxhash import xxh3_64_intdigest

    raw = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES)
    tokens = re.findall(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x00-\x20\x7f-\xff]+", raw)
    if not tokens:
        return np.empty(0, dtype=np.int64), np.empty(0)
    h = np.fromiter(map(xxh3_64_intdigest, tokens), dtype=np.uint64, count=len(tokens))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] + np.uint64(0x632BE59BD9B4E019))
    pairs = pairs * np.uint64(0xC2B2AE3D27D4EB4F)
    # a word that follows itself, at once or after one other, is also the abstract n-gram of a repeated word
    same = np.concatenate([np.full(int((h[d:] == h[:-d]).sum()), d, dtype=np.uint64) for d in (1, 2)]) * np.uint64(0xD6E8FEB86659FD93)
    every = np.concatenate([h, pairs, same]) >> np.uint64(64 - bits)
    index, count = np.unique(every, return_counts=True)
    return index.astype(np.int64), count / np.sqrt(float((count.astype(np.float64) ** 2).sum()))


def _ftrl(rows, bits: int, epochs: int):
    """FTRL-proximal over [(text, label)]; returns (indices, weights), the bias last."""
    import numpy as np

    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    data = []
    for text, label in rows:
        i, x = features(text, bits)
        data.append((np.append(i, size - 1), np.append(x, 1.0), label))

    def weights(i):
        zi, ni = z[i], n[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(epochs):
        for i, x, y in data:
            w = weights(i)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            n2 = n[i] + g * g
            z[i] += g - (np.sqrt(n2) - np.sqrt(n[i])) / ALPHA * w
            n[i] = n2
    used = np.flatnonzero(n)
    return used, weights(used)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          bits: int = BITS, max_rows: int = MAX_TRAIN_ROWS, rows_per_part: int = ROWS_PER_PART, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """Labelled rows -> model (index, summed weight, parts): at most 2^bits + 1 rows; index 2^bits is the bias."""
    order = uniform(seed, F.col("_lid"))
    lab = labels.select(F.col(doc_id).alias("_lid"), F.col(label).cast("int").alias("_y")).where("_lid is not null and _y in (0, 1)")
    lab = lab.where(~is_held_out(F.col("_lid"))).groupBy("_lid").agg(F.min("_y").alias("_y"))  # of two labels the lower one holds
    # the documented bound of the sample: a top-k by hash, so it fits to broadcast
    sample = lab.withColumn("_o", order).orderBy("_o", "_lid").limit(max_rows)
    parts = max(1, -(-min(max_rows, lab.count()) // rows_per_part))
    rows = docs.join(F.broadcast(sample), F.col(doc_id) == F.col("_lid")).select(
        (F.floor(F.col("_o") * 1e9) % parts).cast("int").alias("part"), F.col("_o").alias("o"), F.col(text).alias("t"), F.col("_y").alias("y"))

    def fit(t):
        import pyarrow as pa

        t = t.sort_by([("o", "ascending"), ("t", "ascending")])
        i, w = _ftrl(list(zip(t["t"].to_pylist(), t["y"].to_pylist())), bits, epochs)
        return pa.table({"index": pa.array(i, pa.int64()), "weight": pa.array(w, pa.float64())})

    by_part = rows.groupBy("part").applyInArrow(fit, "index bigint, weight double")
    return by_part.groupBy("index").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("parts"))


def averaged(model: DataFrame, bits: int = BITS):
    """The model as an array of 2^bits + 1 weights, averaged over the parts (a part that never saw a feature has weight 0 there)."""
    import numpy as np

    weights = np.zeros((1 << bits) + 1)
    rows = model.toPandas()  # bounded by 2^bits + 1 rows
    if len(rows):
        index = rows["index"].to_numpy()
        weights[index] = rows["weight"].to_numpy() / rows["parts"].to_numpy()[index == 1 << bits][0]  # every part has the bias
    return weights


def score(docs: DataFrame, model: DataFrame, text: str = "text", bits: int = BITS, keep: list[str] | None = None) -> DataFrame:
    """The input's columns (or ``keep``) with score: one pass, no shuffle. The model (2^bits + 1 weights at most) is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(averaged(model, bits))
    keep = docs.columns if keep is None else keep
    names = [f"_c{i}" for i in range(len(keep))]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        w = sent.value
        for b in batches:
            out = []
            for t in b.column(0):
                i, x = features(t.as_py(), bits)
                out.append(float(1.0 / (1.0 + np.exp(-np.clip(w[i] @ x + w[-1], -35, 35)))))
            yield pa.RecordBatch.from_arrays([*[b.column(j + 1) for j in range(len(names))], pa.array(out, pa.float64())], [*names, "score"])

    schema = T.StructType([T.StructField(x, docs.schema[c].dataType) for c, x in zip(keep, names)] + [T.StructField("score", T.DoubleType())])
    out = docs.select(F.col(text).alias("_text"), *[F.col(f"`{c}`").alias(x) for c, x in zip(keep, names)]).mapInArrow(run, schema)
    return out.select(*[F.col(x).alias(c) for c, x in zip(keep, names)], F.col("score").alias(free_name("score", keep)))
