"""A consensus label for each item, with agreement and the reliability of each annotator.

Method: competence-and-spamming mixture.  Annotator j is truthful with probability theta_j and then gives the
right label, else draws from a guess distribution xi_j of their own; expectation-maximisation yields the
posterior of every item's label, theta and xi.  For an item, a vote for label l by j multiplies the odds of l by
1 + theta_j / ((1 - theta_j) xi_j[l]) and leaves the other labels as they are, so both steps are sums over votes:
joins, windows over an item's votes and one small aggregate by (annotator, label) an iteration.

Votes are reduced to one row an item, which holds its votes as arrays and is written once; the E-step is then a
projection over these rows in NumPy, and an iteration is one aggregate of sums by (annotator, label).  The parameters
have one number for each annotator and label: they are sent to the tasks while there are at most MOST_PARAMETERS of them
(counted, 16 MB), beyond that they stay a table that the votes are joined with, salted by item, so that an annotator
who gave a third of all votes is spread.

Defined results: annotators are read without regard to case and outer spaces, labels also with space or hyphen
for underscore; what is then no label of the codebook, and a null annotator or item, counts as no vote; of several
votes of one annotator for an item the latest counts (by labelled_at, then loaded_at, then the label's name, so
repeated rows count once); ties between labels fall to the first in codebook order; an empty table gives empty
results; other columns, of whatever name, aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collatio.sources import cut_lineage

#: Annotators times labels of which the parameters may be sent to the tasks (8 bytes each).
MOST_PARAMETERS = 2_000_000
#: Parts of an annotator's votes where parameters are a table.
SALTS = 32
#: Labels of a codebook, which is read on the driver.
MOST_LABELS = 1_000
#: Pseudo-counts: of truthful and guessed labels, and of each label among the guesses.
TRUTHFUL, GUESSED, GUESS = 1.0, 0.5, 0.2
ITERATIONS, TOLERANCE = 100, 1e-3
LEAST_ANNOTATORS = 3


def loosely(column: str) -> Column:
    return F.lower(F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", ""))


def _read(items: DataFrame, labels: list[str]) -> DataFrame:
    """(annotation_id, annotator, p, labelled_at, loaded_at) of all rows that are votes; p is the label's codebook position."""
    name = F.regexp_replace(loosely("primary_label"), r"(?U)[\s\-]+", "_")
    position = F.array_position(F.array(*map(F.lit, labels)), name) if labels else F.lit(0)
    rows = items.select("annotation_id", loosely("annotator").alias("annotator"), position.cast("int").alias("p"), "labelled_at", "loaded_at")
    return rows.filter("p > 0 and annotator is not null and annotation_id is not null")


def votes(items: DataFrame, labels: list[str]) -> DataFrame:
    """(annotation_id, annotator, label): one row for each annotator and item; label is the codebook position."""
    latest = F.max_by(F.col("p"), F.struct(F.col("labelled_at"), F.col("loaded_at"), -F.col("p")))
    return _read(items, labels).groupBy("annotation_id", "annotator").agg((latest - 1).alias("label"))


def _posterior(v: DataFrame, parameters: DataFrame, prior: list[float]) -> DataFrame:
    """v with theta, xi (of the vote's label), score, p (posterior of the vote's label) and same (votes for it)."""
    parameters = parameters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    v = v.withColumn("salt", F.pmod(F.xxhash64("annotation_id"), F.lit(SALTS)).cast("int")).join(parameters, ["annotator", "salt"]).drop("salt").withColumn("x", F.col("xi")[F.col("label")])
    bonus = F.log1p(F.col("theta") / ((1 - F.col("theta")) * F.col("x")))
    logs = F.array(*[F.lit(math.log(p)) for p in prior])[F.col("label")]
    of_label, of_item = Window.partitionBy("annotation_id", "label"), Window.partitionBy("annotation_id")
    v = v.withColumns({"score": F.sum(bonus).over(of_label) + logs, "same": F.count("*").over(of_label)})
    v = v.withColumn("top", F.greatest(F.max("score").over(of_item), F.lit(0.0)))
    # each label once: its weight over its votes; labels without votes keep their prior
    voted = F.sum((F.exp(F.col("score") - F.col("top")) - F.exp(logs - F.col("top"))) / F.col("same")).over(of_item)
    return v.withColumn("p", F.exp(F.col("score") - F.col("top")) / (voted + F.exp(-F.col("top"))))


class Fitted(NamedTuple):
    """annotators (the names, in the order of the numbers), theta, xi, n (labels each gave), prior, converged."""

    annotators: list[str]
    theta: np.ndarray
    xi: np.ndarray
    n: np.ndarray
    prior: np.ndarray
    converged: bool


def _posteriors(who: np.ndarray, label: np.ndarray, item: np.ndarray, theta: np.ndarray, xi: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a batch of votes, numbered items from 0 on: (item, label, posterior, votes) of every label that an item has, and
    for each vote how likely it is truthful."""
    n_labels = len(prior)
    t, x = theta[who], xi[who, label]
    keys, at = np.unique(item * n_labels + label, return_inverse=True)
    own_item, own_label, logs = keys // n_labels, keys % n_labels, np.log(prior)
    score = np.bincount(at, np.log1p(t / ((1 - t) * x)), len(keys)) + logs[own_label]
    top = np.zeros(int(item.max()) + 1)
    np.maximum.at(top, own_item, score)
    top = top[own_item]
    # labels without votes keep their prior
    weight = np.exp(score - top)
    whole = np.bincount(own_item, weight - np.exp(logs[own_label] - top))[own_item] + np.exp(-top)
    p = weight / whole
    return own_item, own_label, p, np.bincount(at), p[at] * t / (t + (1 - t) * x)


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(annotator, label, number of the item in the batch) of every vote."""
    who, label = b.column("who"), b.column("label")
    item = np.repeat(np.arange(b.num_rows), pc.list_value_length(who).to_numpy(zero_copy_only=False))
    return who.flatten().to_numpy(zero_copy_only=False).astype(np.int64), label.flatten().to_numpy(zero_copy_only=False).astype(np.int64), item


def fit(rows: DataFrame, names: list[str], n_labels: int, iterations: int = ITERATIONS) -> Fitted:
    """Expectation-maximisation over items (annotation_id, who, label: the votes as arrays of numbers)."""
    theta, xi, prior = np.full(len(names), 0.7), np.full((len(names), n_labels), 1.0 / n_labels), np.full(n_labels, 1.0 / n_labels)
    n, converged = np.zeros((len(names), n_labels)), not names

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        truthful, given, weight = (np.zeros(len(names) * n_labels) for _ in range(3))
        for b in batches:
            if b.num_rows:
                who, label, item = _flat(b)
                _, own, p, _, true = _posteriors(who, label, item, theta, xi, prior)
                cell = who * n_labels + label
                truthful += np.bincount(cell, true, len(truthful))
                given += np.bincount(cell, minlength=len(given))
                weight[:n_labels] += np.bincount(own, p, n_labels)
        seen = np.flatnonzero((given > 0) | (weight > 0))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (seen, truthful[seen], given[seen], weight[seen])], names=["cell", "t", "n", "w"])

    for _ in range(iterations if names else 0):
        sums = rows.select("who", "label").mapInArrow(step, "cell long, t double, n double, w double").groupBy("cell").agg(F.sum("t").alias("t"), F.sum("n").alias("n"), F.sum("w").alias("w")).toArrow().to_pandas()
        truthful, weight = np.zeros(len(names) * n_labels), np.zeros(n_labels)
        n = np.zeros(len(names) * n_labels)
        truthful[sums.cell], n[sums.cell] = sums.t, sums.n
        weight[sums.cell[sums.cell < n_labels]] = sums.w[sums.cell < n_labels]
        truthful, n = truthful.reshape(-1, n_labels), n.reshape(-1, n_labels)
        prior = (weight + 1) / (weight.sum() + n_labels)
        guesses = n - truthful + GUESS
        xi = guesses / guesses.sum(axis=1, keepdims=True)
        old, theta = theta, (truthful.sum(axis=1) + TRUTHFUL) / (n.sum(axis=1) + TRUTHFUL + GUESSED)
        if converged := bool(np.abs(theta - old).max() < TOLERANCE):
            break
    return Fitted(names, theta, xi, n.sum(axis=1).astype(np.int64), prior, converged)


def fit_table(v: DataFrame, n_labels: int, iterations: int = ITERATIONS) -> tuple[DataFrame, list[float], bool]:
    """fit() for any number of annotators: (parameters, prior, converged); parameters has annotator, theta, xi and n."""
    counts = v.groupBy("annotator").agg(F.count("*").alias("n"))
    parameters = cut_lineage(counts.select("annotator", F.lit(0.7).alias("theta"), F.array(*[F.lit(1.0 / n_labels)] * n_labels).alias("xi"), "n"))
    prior, converged = [1.0 / n_labels] * n_labels, False
    for _ in range(iterations):
        q = _posterior(v, parameters.select("annotator", "theta", "xi"), prior)
        q = q.withColumn("truthful", F.col("p") * F.col("theta") / (F.col("theta") + (1 - F.col("theta")) * F.col("x")))
        sums = cut_lineage(q.groupBy("annotator", "label").agg(F.sum("truthful").alias("t"), F.count("*").alias("n"), F.sum(F.col("p") / F.col("same")).alias("w")))
        weight = {r.label: r.w for r in sums.groupBy("label").agg(F.sum("w").alias("w")).collect()}  # at most MOST_LABELS rows
        whole = sum(weight.values()) + n_labels
        prior = [(weight.get(i, 0.0) + 1.0) / whole for i in range(n_labels)]
        guesses = F.map_from_entries(F.collect_list(F.struct("label", (F.col("n") - F.col("t")).alias("g"))))
        new = sums.groupBy("annotator").agg(F.sum("t").alias("t"), F.sum("n").alias("n"), guesses.alias("g"))
        new = new.withColumn("all", F.col("n") - F.col("t") + GUESS * n_labels)
        xi = F.transform(F.sequence(F.lit(0), F.lit(n_labels - 1)), lambda i: (F.coalesce(F.col("g")[i], F.lit(0.0)) + GUESS) / F.col("all"))
        new = cut_lineage(new.select("annotator", ((F.col("t") + TRUTHFUL) / (F.col("n") + TRUTHFUL + GUESSED)).alias("theta"), xi.alias("xi"), "n"))
        moved = new.join(parameters.select("annotator", F.col("theta").alias("old")), "annotator").agg(F.max(F.abs(F.col("theta") - F.col("old")))).first()[0]
        parameters = new
        if converged := moved is None or moved < TOLERANCE:
            break
    return parameters, prior, converged


def _labels(codebook: DataFrame) -> list[str]:
    labels = [r.label for r in codebook.select("label").limit(MOST_LABELS + 1).collect()]
    if len(labels) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    return labels


def _solve(items: DataFrame, codebook: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """(posteriors, parameters, labels).  posteriors: annotation_id, label, p, same (votes for it), n_annotators, one row for each
    label that an item has; parameters: annotator, theta, xi, n, converged."""
    spark, labels = items.sparkSession, _labels(codebook)
    v = votes(items, labels)
    most = MOST_PARAMETERS // max(1, len(labels))
    found = _read(items, labels).select("annotator").distinct().limit(most + 1).collect()
    if len(found) > most:
        v = cut_lineage(v.repartition("annotation_id"))
        parameters, prior, converged = fit_table(v, max(1, len(labels)))
        q = _posterior(v, parameters.select("annotator", "theta", "xi"), prior).groupBy("annotation_id", "label").agg(F.first("p").alias("p"), F.first("same").alias("same"))
        n = F.sum("same").over(Window.partitionBy("annotation_id"))
        return q.withColumn("n_annotators", n), parameters.withColumn("converged", F.lit(converged)), labels
    names = sorted(r.annotator for r in found)
    number = F.broadcast(spark.createDataFrame(list(enumerate(names)), "who int, annotator string"))
    # one row an item; it has one vote of each annotator at most
    rows = v.join(number, "annotator").groupBy("annotation_id").agg(F.collect_list(F.struct("who", "label")).alias("v"))
    rows = cut_lineage(rows.select("annotation_id", F.col("v.who").alias("who"), F.col("v.label").alias("label")))
    f = fit(rows, names, max(1, len(labels)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                who, label, item = _flat(b)
                own, of, p, same, _ = _posteriors(who, label, item, f.theta, f.xi, f.prior)
                n = np.bincount(item, minlength=b.num_rows)[own]
                yield pa.RecordBatch.from_arrays(
                    [b.column("annotation_id").take(pa.array(own)), pa.array(of, pa.int32()), pa.array(p), pa.array(same, pa.int64()), pa.array(n, pa.int64())], names=["annotation_id", "label", "p", "same", "n_annotators"]
                )

    kind = items.schema["annotation_id"].dataType.simpleString()
    q = rows.mapInArrow(score, f"annotation_id {kind}, label int, p double, same long, n_annotators long")
    parameters = spark.createDataFrame([(a, float(t), list(map(float, x)), int(n), f.converged) for a, t, x, n in zip(names, f.theta, f.xi, f.n, strict=True)], "annotator string, theta double, xi array<double>, n long, converged boolean")
    return q, parameters, labels


def consensus(items: DataFrame, codebook: DataFrame, least: int = 1) -> DataFrame:
    """(annotation_id, primary_label, posterior, n_annotators, agreement) of each item with votes of least annotators:
    agreement is the share of its annotators who gave the consensus label."""
    q, _, labels = _solve(items, codebook)
    best = F.max(F.struct(F.col("p"), (-F.col("label")).alias("l"), F.col("same"), F.col("n_annotators")))
    rows = q.filter(F.col("n_annotators") >= least).groupBy("annotation_id").agg(best.alias("b"))
    name = F.element_at(F.array(*map(F.lit, labels)), F.lit(1) - F.col("b.l")) if labels else F.lit(None).cast("string")
    return rows.select(
        "annotation_id", name.alias("primary_label"), F.round("b.p", 6).alias("posterior"), "b.n_annotators",
        F.round(F.col("b.same") / F.col("b.n_annotators"), 9).alias("agreement"),
    )


def found(items: DataFrame, codebook: DataFrame) -> DataFrame:
    """(annotation_id, primary_label) of the items with votes of three annotators or more; consensus() has the others too."""
    return consensus(items, codebook, LEAST_ANNOTATORS).select("annotation_id", "primary_label")


def annotators(items: DataFrame, codebook: DataFrame) -> DataFrame:
    """(annotator, n_labels, reliability, usual_guess, guess_share, converged): theta, the commonest label of the guesses, and
    whether the fit had come to rest when it ended."""
    _, parameters, labels = _solve(items, codebook)
    top = F.array_max("xi")
    return parameters.select(
        "annotator", F.col("n").cast("long").alias("n_labels"), F.round("theta", 4).alias("reliability"),
        F.element_at(F.array(*map(F.lit, labels)), F.array_position("xi", top).cast("int")).alias("usual_guess"), F.round(top, 4).alias("guess_share"), "converged",
    )
