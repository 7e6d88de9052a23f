"""URL filters (native): rules, then gradient-boosted trees on lexical features.

Rules (``host/path``) block or allow a host with its subdomains where the
url's path starts with the rule's; the longest wins. All other urls get the
verdict of the trees.

Features: lengths of url, host and path, path depth, host labels, digit
ratios, hyphens, character entropy, parameter counts, and suffix statistics (the
smoothed share of blocked labelled urls among those whose host ends in the same one,
two or three labels). The trees are fitted on statistics without the url's own fold of ``FOLDS``: without the url alone they
would tell its label, being lower for a blocked url than for an allowed one of the same suffix.

Training: :func:`train` takes labelled urls (url, label), 1 for block. Suffix
statistics count all distinct labelled urls; only the fit of the trees is bounded, to a
sample of ``MAX_TRAIN_ROWS`` (by a hash of the url). Statistics are looked up for
distinct hosts by shuffle joins, then for rows by host.
Trees are Spark ML's, trained and applied in the JVM.

Defined cases: null or unparsable urls (no ``://``) have empty host and path, match no rule
and go to the trees like any other; repeated rows are judged each; without labels of
both kinds in the sample every url without a rule is allowed; an empty table gives an empty result; other columns
pass through :func:`judge` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finledger.llm._common import LOWER, UPPER, seal, text_or_empty, uniform, unseal, written

MAX_TRAIN_ROWS = 20_000
HOT = 1000                   # keys with over 1 / HOT of the rows are looked up by broadcast
SMOOTHING, FOLDS = 10.0, 5
TREES, DEPTH, SEED = 20, 4, 13
FEATURES = ["f_url_len", "f_host_len", "f_path_len", "f_depth", "f_labels", "f_digits", "f_host_digits", "f_hyphens",
            "f_entropy", "f_params", "f_query_len", "f_suffix1", "f_suffix2", "f_suffix3"]
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-._/?&=%#:"


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased), path and _query."""
    u = text_or_empty(url)
    start = F.instr(u, "://")
    rest = F.when(start > 0, F.expr(f"substring(coalesce(`{url}`, ''), instr(coalesce(`{url}`, ''), '://') + 3)")).otherwise("")
    d = df.withColumn("_rest", rest)
    d = d.withColumn("_host", F.regexp_extract("_rest", r"\A[^/?#]*", 0))
    d = d.withColumn("_after", F.expr("substring(_rest, length(_host) + 1)"))
    d = d.withColumn("host", F.translate("_host", UPPER, LOWER))
    d = d.withColumn("path", F.regexp_extract("_after", r"\A[^?#]*", 0))
    return d.withColumn("_query", F.regexp_extract("_after", r"\A[^?#]*\?([^#]*)", 1)).drop("_rest", "_host", "_after")


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits (null if none). Rules are ``host/path`` with a path that starts with ``/``.

    The rules are a parameter of the job, so they are tried as one expression, longest first.
    """
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for r, v in rules.items():
        out = F.when(rule == r, F.lit(v)).otherwise(out)
    return out


def labels_from_rules(pages: DataFrame, rules: dict[str, str], bad_words: list[str], url: str = "url") -> DataFrame:
    """Labelled urls (url, label): the rules' verdicts; of the rest, hosts with a bad word are bad and others good."""
    d = with_parts(pages.select(F.col(url).alias("url")), "url")
    bad = F.lit(False)
    for w in bad_words:
        bad = bad | F.contains("host", F.lit(w))
    ruled = verdict_of(rule_of(F.col("host"), F.col("path"), rules), rules)
    return d.select("url", F.when(ruled == "block", 1).when(ruled == "allow", 0).when(bad, 1).otherwise(0).alias("label"))


def _ratio(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.greatest(whole, F.lit(1)).cast("double")


def _without(c: Column, chars: str) -> Column:
    return F.length(c) - F.length(F.translate(c, chars, ""))


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds the lexical features and the host suffixes _s1, _s2, _s3. Needs :func:`with_parts`."""
    df = df.withColumn("_u", F.translate(text_or_empty(url), UPPER, LOWER))
    u = F.col("_u")
    n = F.length(u).cast("double")
    counts = F.transform(F.array(*[F.lit(c) for c in _ALPHABET]), lambda c: F.length(u) - F.length(F.replace(u, c, F.lit(""))))
    df = df.withColumn("_k", counts)
    df = df.withColumn("_k", F.concat("_k", F.array(F.length(u) - F.aggregate("_k", F.lit(0), lambda a, k: a + k))))
    # H = log2 n - sum(k log2 k) / n
    klogk = F.aggregate("_k", F.lit(0.0), lambda a, k: a + F.when(k > 1, k.cast("double") * F.log2(k.cast("double"))).otherwise(0.0))
    entropy = F.when(n > 0, F.log2(n) - klogk / n).otherwise(0.0)
    h, p, q = F.col("host"), F.col("path"), F.col("_query")
    return df.withColumns({
        "f_url_len": n, "f_host_len": F.length(h).cast("double"), "f_path_len": F.length(p).cast("double"),
        "f_depth": _without(p, "/").cast("double"),
        "f_labels": F.when(h == "", 0.0).otherwise((_without(h, ".") + 1).cast("double")),
        "f_digits": _ratio(_without(u, "0123456789"), F.length(u)), "f_host_digits": _ratio(_without(h, "0123456789"), F.length(h)),
        "f_hyphens": _without(h, "-").cast("double"), "f_entropy": entropy,
        "f_params": F.when(q == "", 0.0).otherwise((_without(q, "&") + 1).cast("double")), "f_query_len": F.length(q).cast("double"),
        **_suffixes(h),
    }).drop("_u", "_k")


def _suffixes(host: Column) -> dict[str, Column]:
    return {f"_s{i}": F.substring_index(host, ".", -i) for i in (1, 2, 3)}


def _by_suffix(hosts: DataFrame, *sums: Column) -> DataFrame:
    """(level, suffix, sums) of distinct hosts; map-side combined, so a hot suffix is a row for each task."""
    s = _suffixes(F.col("host"))
    suffix = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), s[f"_s{i}"].alias("suffix")) for i in (1, 2, 3)]))
    return hosts.withColumn("_s", suffix).groupBy("_s.level", "_s.suffix").agg(*sums)


def _look_up(df: DataFrame, key: str, found: DataFrame, rows: int) -> DataFrame:
    """``df`` (of ``rows`` rows) with the columns of ``found``: a row for each value of ``key``, with _rows, the rows of ``df`` that have it.

    A shuffle join but for the values with over 1 / ``HOT`` of the rows: they are fewer than ``HOT``, so they are
    broadcast, and none of them fills a task.
    """
    often = F.col("_rows") * HOT > rows
    hot, others = found.where(often).drop("_rows"), found.where(~often).drop("_rows")
    rare = df.join(F.broadcast(hot.select(key)), key, "left_anti")
    return df.join(F.broadcast(hot), key).unionByName(rare.join(others, key, "left"))


def _fold(seed: int) -> Column:
    return F.floor(uniform(seed + 1, F.col("url")) * FOLDS).cast("int")


def _statistics(every: DataFrame, seed: int) -> DataFrame:
    """(level, suffix, n, bad, n_of, bad_of): distinct labelled urls and those to block, in all and of each fold."""
    parts = {f"n{k}": F.when(F.col("_fold") == k, 1).otherwise(0) for k in range(FOLDS)}
    parts |= {f"bad{k}": F.when(F.col("_fold") == k, F.col("_y")).otherwise(0) for k in range(FOLDS)}
    hosts = with_parts(every, "url").withColumn("_fold", _fold(seed)).groupBy("host").agg(*[F.sum(c).alias(k) for k, c in parts.items()])
    sums = _by_suffix(hosts, *[F.sum(k).alias(k) for k in parts])
    n, bad = ([F.col(f"{x}{k}") for k in range(FOLDS)] for x in ("n", "bad"))
    return sums.select("level", "suffix", sum(n[1:], n[0]).alias("n"), sum(bad[1:], bad[0]).alias("bad"),
                       F.array(*n).alias("n_of"), F.array(*bad).alias("bad_of"))


def _with_statistics(df: DataFrame, stats: DataFrame, prior: float, fold: Column | None = None) -> DataFrame:
    """Adds f_suffix1..3: smoothed shares of blocked urls; ``fold`` leaves the row's own fold out."""
    hosts = written(df.groupBy("host").agg(F.count(F.lit(1)).alias("_rows")), "url-hosts")
    sums = ["n", "bad"] if fold is None else ["n", "bad", "n_of", "bad_of"]
    size = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum("_rows").alias("rows")).first()
    none = F.array_repeat(F.lit(0).cast("long"), FOLDS)
    wanted = _by_suffix(hosts, F.count(F.lit(1)).alias("_hosts"))
    known = written(wanted.join(stats, ["level", "suffix"], "left"), "url-known")
    each = hosts.withColumnRenamed("_rows", "_host_rows").withColumns(_suffixes(F.col("host")))
    for i in (1, 2, 3):
        s = known.where(F.col("level") == i).select(F.col("suffix").alias(f"_s{i}"), F.col("_hosts").alias("_rows"),
                                                    *[F.col(x).alias(f"_{x}{i}") for x in sums])
        each = written(_look_up(each, f"_s{i}", s, size["hosts"]), "url-hosts")
    found = each.withColumnRenamed("_host_rows", "_rows").drop("_s1", "_s2", "_s3")
    df = _look_up(df, "host", found, size["rows"] or 0)
    for i in (1, 2, 3):
        n, bad = F.coalesce(f"_n{i}", F.lit(0)), F.coalesce(f"_bad{i}", F.lit(0))
        if fold is not None:
            n, bad = n - F.get(F.coalesce(f"_n_of{i}", none), fold), bad - F.get(F.coalesce(f"_bad_of{i}", none), fold)
        df = df.withColumn(f"f_suffix{i}", (bad + F.lit(SMOOTHING * prior)) / (n + F.lit(SMOOTHING))).drop(*[f"_{x}{i}" for x in sums])
    return df


class UrlModel:
    """Suffix statistics and trees fitted on labelled urls."""

    def __init__(self, stats: DataFrame | None, prior: float, trees):
        self.stats, self.prior, self.trees = stats, prior, trees

    def score(self, df: DataFrame, url: str = "url") -> DataFrame:
        """Adds bad_score, the trees' probability of block. Needs :func:`with_parts`."""
        if self.trees is None:
            return df.withColumn("bad_score", F.lit(0.0))
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        d = lexical(_with_statistics(df, self.stats, self.prior), url)
        d = self.trees.transform(VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(d))
        d = d.withColumn("bad_score", vector_to_array("_probability")[1])
        return d.drop(*FEATURES, "_s1", "_s2", "_s3", "_features", "_raw", "_probability", "_prediction")


def train(labelled: DataFrame, url: str = "url", label: str = "label", max_rows: int = MAX_TRAIN_ROWS,
          trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> UrlModel:
    """Labelled urls -> model: statistics of all distinct urls, trees fitted on at most ``max_rows`` of them by hash order.

    Each label is sampled on its own, half of ``max_rows`` at most, and weighs what it has in all urls: a rare label is
    never missed. Without urls of both labels there are no trees, and every url is allowed.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    every = labelled.select(F.col(url).alias("url"), F.col(label).cast("int").alias("_y")).where("url is not null")
    every = every.groupBy("url").agg(F.max("_y").alias("_y")).where("_y in (0, 1)")  # of two labels of one url the bad one holds
    every = written(every, "url-labels")
    whole = every.agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("bad")).first()
    of = {0: whole["n"] - (whole["bad"] or 0), 1: whole["bad"] or 0}
    if not of[0] or not of[1]:
        return UrlModel(None, 0.0, None)
    ordered = every.withColumn("_o", uniform(seed, F.col("url")))
    share = max(1, max_rows // 2)
    some = [ordered.where(F.col("_y") == y).orderBy("_o", "url").limit(share).withColumn("_weight", F.lit(of[y] / min(share, of[y]))) for y in (0, 1)]
    rows = written(lexical(with_parts(some[0].unionByName(some[1]), "url"), "url").drop("_o"), "url-sample")
    stats = written(_statistics(every, seed), "url-suffixes")
    prior = whole["bad"] / whole["n"]
    train_rows = _with_statistics(rows, stats, prior, _fold(seed))
    train_rows = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(train_rows).select("_features", "_weight", F.col("_y").cast("double").alias("_label"))
    gbt = GBTClassifier(featuresCol="_features", labelCol="_label", weightCol="_weight", maxIter=trees, maxDepth=depth, seed=seed, predictionCol="_prediction")
    gbt = gbt.setProbabilityCol("_probability").setRawPredictionCol("_raw")
    return UrlModel(stats, prior, gbt.fit(train_rows))


def judge(pages: DataFrame, model: UrlModel, rules: dict[str, str], url: str = "url", threshold: float = 0.5) -> DataFrame:
    """The pages with host, path, rule, verdict and bad_score."""
    d = model.score(with_parts(seal(pages, url=url), "url"), "url")
    d = d.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_trees = F.when(F.col("bad_score") >= threshold, "block").otherwise("allow")
    d = d.withColumn("verdict", F.coalesce(verdict_of(F.col("rule"), rules), by_trees))
    return unseal(d, pages, added=["host", "path", "rule", "verdict", "bad_score"])
