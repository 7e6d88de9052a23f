"""Text models for keyword misses (ML0-ML6, IO9).

Features reproduce a TF-IDF over word 1- and 2-grams: ``(?U)\\w\\w+`` tokens, lower-cased; smooth idf
``ln((1+n)/(1+df)) + 1``; L2 row norm. Three multinomial logistic regressions with C=1 (``regParam = 1/n``, no
standardisation, unregularised intercept):

* debit type: Savings/Investment for savings categories, else Expense;
* expense category: savings categories become "Other";
* savings category: non-savings categories become "Other".

A model with fewer than two classes is not trained (its predictions are null with confidence 0). The training bag is
aggregated to distinct (description, category) with a weight column, which is the same objective as the
duplicated rows; document frequencies are weighted the same way.

Terms live in a table: (term, term_id, df, idf) numbered by distributed ranks, later with the coefficients of each model. Texts meet
it by a join, in training and in scoring, so no vocabulary is collected; a score is a join, sums and a softmax, all built-in
expressions. Only what a fit itself holds reaches the driver: its coefficients, and the classes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finledger.operators.corrections import weighted_bag
from finledger.session import fresh_dir
from finledger.sources import manifest
from finledger.sources.manifest import Version
from finledger.taxonomy import ALL_SAVINGS_CATEGORIES, CONFIDENCE_THRESHOLD, EXPENSE, SAVINGS

TOKEN_PATTERN = r"(?U)\w\w+"
MAX_ITER = 600
TOLERANCE = 1e-4
MODEL_NAMES = ("debit_type", "expense", "savings")
_TERM_SCHEMA = "term string, term_id long, df double, idf double"
_MODEL_SCHEMA = _TERM_SCHEMA + "".join(f", c_{name} array<double>" for name in MODEL_NAMES)


def _minus(column: str):
    return lambda v: F.exp(v - F.col(column))


def _over(column: str):
    return lambda v: v / F.col(column)


def model_label(name: str, category: Column) -> Column:
    """What a model learns for a category."""
    is_sav = category.isin(ALL_SAVINGS_CATEGORIES)
    if name == "debit_type":
        return F.when(is_sav, F.lit(SAVINGS)).otherwise(F.lit(EXPENSE))
    if name == "expense":
        return F.when(is_sav, F.lit("Other")).otherwise(category)
    if name == "savings":
        return F.when(is_sav, category).otherwise(F.lit("Other"))
    raise ValueError(name)


# ---------------------------------------------------------------- ML0: terms and features


def terms_of(text: Column) -> Column:
    """All 1- and 2-grams of a text, repeats included."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0))
    pairs = F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda i: F.concat_ws(" ", F.get(tokens, i - 1), F.get(tokens, i)))
    return F.concat(tokens, F.when(F.size(tokens) > 1, pairs).otherwise(F.array().cast("array<string>")))


def term_table(wbag: DataFrame) -> DataFrame:
    """(term, term_id, df, idf) of a weighted bag, as a written table. Ids are gapless, in the order of the terms: ranks inside ranges of terms, and
    for each range the number of terms before it (as many rows as ranges)."""
    spark = wbag.sparkSession
    docs = wbag.groupBy("description").agg(F.sum("weight").alias("weight"))
    n = docs.agg(F.sum("weight")).first()[0] or 0.0
    counted = docs.select(F.explode(F.array_distinct(terms_of(F.col("description")))).alias("term"), "weight").groupBy("term").agg(F.sum("weight").alias("df"))
    path = fresh_dir(spark, "ml-term-counts")
    counted.repartitionByRange("term").withColumn("part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.schema("term string, df double, part int").parquet(path)
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("term")))
    numbered = numbered.join(F.broadcast(sizes.select(F.col("part").alias("_p"), before.alias("before"))), F.col("part") == F.col("_p"))
    idf = F.log((F.lit(1.0) + F.lit(float(n))) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    out = fresh_dir(spark, "ml-terms")
    numbered.select("term", (F.col("before") + F.col("rank") - 1).alias("term_id"), "df", idf.alias("idf")).write.parquet(out)
    return spark.read.schema(_TERM_SCHEMA).parquet(out)


def _known_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(text, x = tf * idf, columns of the term table): one row for each text and term that the table has."""
    tf = texts.select("text", F.explode(terms_of(F.col("text"))).alias("_term")).groupBy("text", "_term").agg(F.count(F.lit(1)).alias("tf"))
    j = tf.join(terms, F.col("_term") == F.col("term"))
    return j.withColumn("x", F.col("tf") * F.col("idf")).drop("_term", "tf")


def features(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """ML0: (text, term, term_id, weight) of distinct texts, rows of a text with length 1."""
    known = _known_terms(texts, terms)
    norms = known.groupBy("text").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return known.join(norms.select(F.col("text").alias("_t"), "norm"), F.col("text") == F.col("_t")).select(
        "text", "term", "term_id", (F.col("x") / F.col("norm")).alias("weight"))


def _vectors(long: DataFrame, size: int) -> DataFrame:
    """(text, ml_features): sparse vectors of the distinct texts of the bag (the fit wants them)."""
    make = F.udf(lambda ids, values: Vectors.sparse(size, ids, values), VectorUDT())
    rows = long.groupBy("text").agg(F.sort_array(F.collect_list(F.struct("term_id", "weight"))).alias("e"))
    return rows.select("text", make("e.term_id", "e.weight").alias("ml_features"))


# ---------------------------------------------------------------- the model


def fingerprint(bag: DataFrame) -> DataFrame:
    """ML5: order-free fingerprint of the training bag: (row count, sum of 60 bits of an md5 of each row).

    Accepts the raw bag or the weighted bag (``weight`` = copies of a row); both give the same fingerprint.
    """
    text = F.concat(F.coalesce("description", F.lit("")), F.lit("|"), F.coalesce("category", F.lit("")))
    h = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("decimal(20,0)")
    w = F.col("weight").cast("decimal(18,0)") if "weight" in bag.columns else F.lit(1).cast("decimal(18,0)")
    return bag.agg(F.coalesce(F.sum(w), F.lit(0)).cast("long").alias("n"),
                   F.coalesce(F.sum((h * w).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("h"))


def class_counts(bag: DataFrame) -> DataFrame:
    """ML1-ML3: (model, label, idx, weight): the classes of each model, numbered by name, with their training examples.

    A model with one class only is listed, and not trained.
    """
    w = F.col("weight") if "weight" in bag.columns else F.lit(1.0)
    per = bag.groupBy("category").agg(F.sum(w).alias("weight"))
    rows = [per.select(F.lit(name).alias("model"), model_label(name, F.col("category")).alias("label"), "weight") for name in MODEL_NAMES]
    out = rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("model", "label").agg(F.sum("weight").alias("weight"))
    idx = F.row_number().over(Window.partitionBy("model").orderBy("label")) - 1      # a few dozen classes
    return out.select("model", "label", idx.cast("int").alias("idx"), "weight")


@dataclass
class LedgerModels:
    """A trained snapshot: the folder of its term table with the coefficients, and of each model the classes and intercepts."""

    path: str
    labels: dict[str, list[str]]
    intercepts: dict[str, list[float]]
    threshold: float = CONFIDENCE_THRESHOLD
    fp: tuple[int, str] = field(default=(0, "0"))

    def terms(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_MODEL_SCHEMA).parquet(f"{self.path}/terms")

    # ------------------------------------------------------------ scoring
    def probabilities(self, texts: DataFrame) -> DataFrame:
        """(text, p_<name>): the class probabilities of distinct texts; texts without a known term have the intercepts alone."""
        known = _known_terms(texts, self.terms(texts.sparkSession))
        sums = [F.sum(F.col("x") * F.get(f"c_{n}", F.lit(k))).alias(f"{n}_{k}") for n, b in self.intercepts.items() for k in range(len(b))]
        if not sums:
            return texts.select("text")
        per = known.groupBy("text").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), *sums)
        j = texts.join(per.withColumnRenamed("text", "_t"), F.col("text") == F.col("_t"), "left")
        # one step a column, so that nothing is evaluated twice
        z = {n: F.array(*[F.coalesce(F.col(f"{n}_{k}") / F.col("norm"), F.lit(0.0)) + F.lit(x) for k, x in enumerate(b)]) for n, b in self.intercepts.items()}
        out = j.select("text", *[v.alias(f"z_{n}") for n, v in z.items()])
        out = out.select("*", *[F.array_max(f"z_{n}").alias(f"m_{n}") for n in z])
        out = out.select("text", *[F.transform(f"z_{n}", _minus(f"m_{n}")).alias(f"e_{n}") for n in z])
        out = out.select("*", *[F.aggregate(f"e_{n}", F.lit(0.0), lambda a, v: a + v).alias(f"s_{n}") for n in z])
        out = out.select("text", *[F.transform(f"e_{n}", _over(f"s_{n}")).alias(f"p_{n}") for n in z])
        return out.select("text", *[f"p_{n}" for n in self.intercepts])

    def score(self, df: DataFrame, text_col: str) -> DataFrame:
        """ML6: add ``ml_<name>`` label and ``ml_<name>_conf`` for each model."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        p = self.probabilities(df.select(text.alias("text")).distinct())
        cols = []
        for name in MODEL_NAMES:
            if name in self.intercepts:
                best = F.array_position(F.col(f"p_{name}"), F.array_max(f"p_{name}")).cast("int")
                cols += [F.get(F.lit(self.labels[name]), best - 1).alias(f"ml_{name}"), F.array_max(f"p_{name}").alias(f"ml_{name}_conf")]
            else:
                cols += [F.lit(None).cast("string").alias(f"ml_{name}"), F.lit(0.0).alias(f"ml_{name}_conf")]
        scored = p.select(F.col("text").alias("_scored"), *cols)
        return df.join(scored, text == F.col("_scored"), "left").drop("_scored")

    def classify_kwargs(self) -> dict:
        return {
            "ml_type": F.col("ml_debit_type"), "ml_type_conf": F.col("ml_debit_type_conf"),
            "ml_savings": F.col("ml_savings"), "ml_savings_conf": F.col("ml_savings_conf"),
            "ml_expense": F.col("ml_expense"), "ml_expense_conf": F.col("ml_expense_conf"),
            "threshold": self.threshold,
        }

    # ------------------------------------------------------------ storage (IO9)
    def save(self, path: str) -> None:
        """A folder that holds all of the snapshot; it does not depend on the one it was trained in."""
        spark = SparkSession.getActiveSession()
        self.terms(spark).write.mode("overwrite").parquet(f"{path}/terms")
        classes = [(name, i, lab, float(b)) for name in self.intercepts for i, (lab, b) in enumerate(zip(self.labels[name], self.intercepts[name]))]
        spark.createDataFrame(classes, "model string, idx int, label string, intercept double").write.mode("overwrite").parquet(f"{path}/classes")
        spark.createDataFrame([(self.fp[0], self.fp[1], self.threshold)], "n long, h string, threshold double").write.mode("overwrite").parquet(f"{path}/fingerprint")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "LedgerModels":
        labels: dict[str, list[str]] = {}
        intercepts: dict[str, list[float]] = {}
        for r in spark.read.parquet(f"{path}/classes").orderBy("model", "idx").collect():  # at most a few dozen classes
            labels.setdefault(r.model, []).append(r.label)
            intercepts.setdefault(r.model, []).append(r.intercept)
        fp = spark.read.parquet(f"{path}/fingerprint").first()
        return LedgerModels(path, labels, intercepts, fp.threshold, (fp.n, fp.h))


def train(bag: DataFrame, max_iter: int = MAX_ITER, previous: LedgerModels | None = None,
          partitions: int = 8) -> LedgerModels | None:
    """Train the three models on a training bag (description, category).

    ``partitions``: tasks of each iteration of a fit, a deployment's choice (about one for 50,000 distinct
    texts); it is the same at every size of the bag, so sums are added in the same order.

    Returns None when the bag is empty (ML4), or ``previous`` when its
    fingerprint is unchanged (ML5).
    """
    spark = bag.sparkSession
    wbag = weighted_bag(bag.select(F.coalesce("description", F.lit("")).alias("description"), "category")).cache()
    try:
        fp_row = fingerprint(wbag).first()
        fp = (int(fp_row.n), fp_row.h)
        if fp[0] == 0:
            return None
        if previous is not None and previous.fp == fp:
            return previous
        terms = term_table(wbag)
        size = max(1, terms.count())
        texts = wbag.select(F.col("description").alias("text")).distinct()
        vectors = texts.join(_vectors(features(texts, terms), size).withColumnRenamed("text", "_t"), F.col("text") == F.col("_t"), "left").drop("_t")
        empty = F.udf(lambda v: v if v is not None else Vectors.sparse(size, [], []), VectorUDT())
        data = wbag.join(vectors, F.col("description") == F.col("text")).repartition(partitions, "description")
        data = data.select(empty("ml_features").alias("ml_features"), "weight", "category").cache()
        coefficients, labels, intercepts = {}, {}, {}
        for name in MODEL_NAMES:
            lab = data.withColumn("label_text", model_label(name, F.col("category")))
            classes = [r[0] for r in lab.select("label_text").distinct().orderBy("label_text").collect()]
            if len(classes) < 2:
                continue
            idx = F.array_position(F.lit(classes), F.col("label_text")) - 1
            lr = LogisticRegression(featuresCol="ml_features", labelCol="label", weightCol="weight",
                                    maxIter=max_iter, regParam=1.0 / fp[0], elasticNetParam=0.0,
                                    standardization=False, fitIntercept=True, family="auto", tol=TOLERANCE)
            m = lr.fit(lab.withColumn("label", idx.cast("double")))
            matrix, b = m.coefficientMatrix.toArray(), m.interceptVector.toArray()
            if len(classes) == 2:      # one row of differences: the first class is 0
                matrix, b = [[0.0] * size, matrix[0]], [0.0, b[0]]
            coefficients[name], labels[name], intercepts[name] = matrix, classes, [float(x) for x in b]
        data.unpersist()
        path = fresh_dir(spark, "ml-model")
        _with_coefficients(terms, coefficients, size).write.parquet(f"{path}/terms")
        return LedgerModels(path, labels, intercepts, CONFIDENCE_THRESHOLD, fp)
    finally:
        wbag.unpersist()


def _with_coefficients(terms: DataFrame, coefficients: dict, size: int) -> DataFrame:
    """The term table with an array of coefficients, one for each class, of each trained model."""
    import numpy as np
    import pyarrow as pa

    spark, out = terms.sparkSession, terms
    for name in MODEL_NAMES:
        if name not in coefficients:
            out = out.withColumn(f"c_{name}", F.lit(None).cast("array<double>"))
            continue
        by_term = np.ascontiguousarray(np.asarray(coefficients[name]).T)
        offsets = np.arange(size + 1, dtype=np.int32) * by_term.shape[1]
        rows = pa.table({"_id": pa.array(np.arange(size)), f"c_{name}": pa.ListArray.from_arrays(pa.array(offsets), pa.array(by_term.ravel()))})
        out = out.join(spark.createDataFrame(rows), F.col("term_id") == F.col("_id"), "left").drop("_id")
    return out


def gradient_norm(models: LedgerModels, bag: DataFrame, name: str) -> float:
    """Length of the gradient of a model's penalised loss at its fitted weights, summed over all of the bag: 0 at the optimum.

    The loss is the weighted mean of the log loss plus |w|^2 / 2n; a distributed pass, of which one number reaches the driver.
    """
    spark = bag.sparkSession
    wbag = weighted_bag(bag.select(F.coalesce("description", F.lit("")).alias("description"), "category"))
    classes, n = models.labels[name], float(models.fp[0])
    free: Sequence[int] = range(len(classes)) if len(classes) > 2 else [1]
    label = model_label(name, F.col("category"))
    per = wbag.groupBy("description").agg(F.sum("weight").alias("w"), *[
        F.sum(F.when(label == c, F.col("weight")).otherwise(0.0)).alias(f"y{k}") for k, c in enumerate(classes)])
    p = models.probabilities(per.select(F.col("description").alias("text")))
    r = per.join(p, F.col("description") == F.col("text")).select(
        "text", *[(F.col("w") * F.get(f"p_{name}", F.lit(k)) - F.col(f"y{k}")).alias(f"r{k}") for k in free])
    long = features(per.select(F.col("description").alias("text")), models.terms(spark).drop(*[f"c_{m}" for m in MODEL_NAMES]))
    by_term = long.join(r.withColumnRenamed("text", "_t"), F.col("text") == F.col("_t")).groupBy("term_id").agg(
        *[F.sum(F.col("weight") * F.col(f"r{k}")).alias(f"g{k}") for k in free])
    coef = models.terms(spark).select(F.col("term_id").alias("_id"), F.col(f"c_{name}").alias("c"))
    g = coef.join(by_term, F.col("_id") == F.col("term_id"), "left")
    squares = sum((F.coalesce(F.col(f"g{k}"), F.lit(0.0)) / n + F.get("c", F.lit(k)) / n) ** 2 for k in free)
    weights = g.agg(F.sum(squares)).first()[0] or 0.0
    bias = r.agg(*[F.sum(f"r{k}") for k in free]).first()
    return (weights + sum((x / n) ** 2 for x in bias)) ** 0.5


# ---------------------------------------------------------------- ML5, IO9: registry


def train_or_reuse(bag: DataFrame, registry: str, max_iter: int = MAX_ITER) -> tuple[LedgerModels | None, bool]:
    """The models of a bag from the registry, where any earlier training on the same bag left them; else trained and registered.

    The registry holds one folder for each fingerprint, counted from its commit on (:mod:`finledger.sources.manifest`). Returns (models, reused).
    """
    spark, registry = bag.sparkSession, registry.rstrip("/")
    fp = fingerprint(bag).first()
    if fp.n == 0:
        return None, False
    name = f"{fp.n}-{fp.h}"
    while True:
        now = manifest.state(spark, registry)
        if any(v.name == name for v in now.live):
            return LedgerModels.load(spark, f"{registry}/model={name}"), True
        models = train(bag, max_iter)
        models.save(f"{registry}/model={name}")
        if manifest.commit(spark, registry, now, [*now.live, Version(name, rows=fp.n)], kind="model", n=fp.n, h=fp.h):
            return LedgerModels.load(spark, f"{registry}/model={name}"), False
