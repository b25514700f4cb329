"""Quality classifier: a sparse ensemble of rules over text statistics.

The statistics of a text are Spark column expressions. A forest of shallow trees is grown on them, every
path from a root to a node becomes a rule (a conjunction of bounds on statistics), and a logistic regression
with an L1 penalty gives most rules the weight zero. What is left is compiled to one column expression, so
scoring is a projection without Python.

Labels are learned from a sample of at most ``most_rows`` labelled rows, those whose doc_id has the smallest
hash; statistics are only computed for them. The tables that reach the driver are the trees and weights,
bounded by TREES and DEPTH.

Defined results
* null text counts as empty; every statistic of an empty text is 0, and it gets a score like any other.
* labels that are null, or whose document is missing, add nothing; repeated rows count as often as they occur.
* without labels of both kinds nothing can be learned: the score is the share of label 1, or 0.5 without any.
* Empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm import shared
from pathloom.llm.quality_rules import words_of

MOST_ROWS, TREES, DEPTH, PENALTY, SEED = 20_000, 20, 3, 0.003, 7
#: Counts of these patterns per word are statistics (fixed values).
PER_WORD = {
    "symbols": r"[#*$%&<>|]",
    "mark_runs": r"[!?]{2,}|[#*$%&]{2,}",
    "commas": r"[,;:]",
    "ends": r"[.!?]",
    "digits": r"[0-9]",
    "capitals": r"\p{Lu}",
    "all_capitals": r"\b\p{Lu}{2,}\b",
    "repeats": r"(?i)\b(\w+)\s+\1\b",
}


def with_statistics(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with a column for each statistic of ``text``, and their names."""
    base = docs.withColumn("_t", F.coalesce(F.col("text"), F.lit(""))).withColumn("_w", words_of(F.col("_t")))
    words = F.greatest(F.size("_w"), F.lit(1))
    made: dict[str, Column] = {f"s_{k}": F.regexp_count("_t", F.lit(p)) / words for k, p in PER_WORD.items()}
    made["s_words"] = F.log1p(F.size("_w"))
    made["s_length"] = F.length("_t") / words
    made["s_distinct"] = F.size(F.array_distinct("_w")) / words
    made["s_lines"] = F.regexp_count("_t", F.lit("\n")) / words
    return base.withColumns({k: c.cast("double") for k, c in made.items()}).drop("_w", "_t"), list(made)


Rule = tuple[tuple[str, str, float], ...]  # (statistic, "<=" or ">", bound), in order of statistics


@dataclass(frozen=True)
class Model:
    """A score: the logistic function of intercept plus the weights of the rules that hold."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for name, side, bound in rule:
        out = out & (F.col(name) <= F.lit(bound) if side == "<=" else F.col(name) > F.lit(bound))
    return out


def _paths(node, names: list[str], bounds: dict[tuple[str, str], float]) -> list[Rule]:
    """The rules of all nodes below ``node``; of several bounds on one side the tightest counts."""
    found = [tuple((n, s, b) for (n, s), b in sorted(bounds.items()))] if bounds else []
    if node.numDescendants() == 0:
        return found
    split = node.split()
    name, bound = names[split.featureIndex()], split.threshold()
    for side, child, tighter in (("<=", node.leftChild(), min), (">", node.rightChild(), max)):
        key = (name, side)
        found += _paths(child, names, bounds | {key: tighter(bounds.get(key, bound), bound)})
    return found


def sample(labels: DataFrame, docs: DataFrame, label: str, most_rows: int) -> DataFrame:
    """doc_id, text and label of at most ``most_rows`` labelled documents, the same in every run."""
    chosen = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.col(label).cast("double").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(most_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS) -> Model:
    """Learn to tell label 1 from label 0 by the statistics of the texts."""
    measured, names = with_statistics(sample(labels, docs, label, most_rows))
    rows = shared.settle(measured.select("label", *names), "statistics")
    seen = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(seen) < 2:
        share = (seen.get(1.0, 0) + 1) / (sum(seen.values()) + 2) if seen else 0.5
        return Model(math.log(share / (1 - share)), ())
    vectors = rows.select("label", array_to_vector(F.array(*names)).alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt", minInstancesPerNode=5, cacheNodeIds=False).fit(vectors)
    rules = sorted({rule for tree in forest.trees for rule in _paths(tree._call_java("rootNode"), names, {})})
    if not rules:
        share = seen[1.0] / sum(seen.values())
        return Model(math.log(share / (1 - share)), ())
    held = rows.select("label", array_to_vector(F.array(*[holds(r).cast("double") for r in rules])).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=60, standardization=False).fit(held)
    weights = [(r, float(w)) for r, w in zip(rules, lasso.coefficients, strict=True) if w]
    return Model(float(lasso.intercept), tuple(weights))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.5 on)."""
    measured, _ = with_statistics(docs.select("doc_id", "text"))
    out = measured.select("doc_id", model.score().alias("score"))
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
