"""Quality scores from a sparse rule ensemble.

Shallow trees are grown over text statistics; every path from a root to a node is a rule, a
conjunction of comparisons. A lasso logistic regression over the rules as 0/1 features
keeps few of them. What is left is compiled into one Spark column expression, so scoring
a corpus is a projection in generated code over built-in functions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from labelmill.llm.steps import saved

#: Labelled texts that the rules are fitted on.
SAMPLE = 20_000
TREES, DEPTH, LASSO, SEED = 12, 3, 0.002, 7


def _count(text: Column, what: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))).cast("double")


def statistics(text: Column, words: Column) -> dict[str, Column]:
    """Statistics of a text (null counts as empty) and its words, by built-in functions."""
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    tokens = F.greatest(F.size(words), F.lit(1)).cast("double")
    match = lambda p: F.regexp_count(text, F.lit(p)).cast("double")
    return {
        "chars": F.length(text).cast("double"),
        "tokens": F.size(words).cast("double"),
        "word_length": (F.length(text) - F.size(words)) / tokens,
        "distinct": F.size(F.array_distinct(words)) / tokens,
        "lines_per_token": (_count(text, "\n") + 1) / tokens,
        "bars": _count(text, "|") / tokens,
        "stops": _count(text, ".") / tokens,
        "symbols": match(r"[#$%&*!@^~=+<>{}\[\]_\\/]+") / tokens,
        "shouts": match(r"\p{Lu}{2,}") / tokens,
        "digits": match(r"[0-9]+") / tokens,
        "other": match(r"[^\p{L}\p{N}\s.,;:!?'\"()-]") / chars,
    }


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs and a struct column ``_s`` of statistics."""
    base = docs.withColumn("_t", F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn("_w", F.filter(F.split("_t", r"\s+"), lambda w: w != ""))
    stats = statistics(F.col("_t"), F.col("_w"))
    return base.withColumn("_s", F.struct(*[v.alias(k) for k, v in stats.items()])).drop("_t", "_w")


@dataclass(frozen=True)
class Rule:
    """All of the parts hold: (statistic, is it at most, bound)."""

    parts: tuple[tuple[str, bool, float], ...]

    def column(self, of=lambda name: F.col(f"_s.{name}")) -> Column:
        return reduce(lambda a, b: a & b, [of(n) <= v if low else of(n) > v for n, low, v in self.parts])


@dataclass
class RuleEnsemble:
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def score(self) -> Column:
        """The probability of label 1 as an expression over ``_s``."""
        total = F.lit(float(self.intercept))
        for rule, w in zip(self.rules, self.weights):
            total = total + F.when(rule.column(), float(w)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def _paths(node, names: list[str], path: tuple = ()) -> list[Rule]:
    """Rules of all nodes below a tree's root: the tightest bound per statistic and side."""
    out = []
    if path:
        best: dict[tuple[str, bool], float] = {}
        for n, low, v in path:
            best[n, low] = v if (n, low) not in best else (min if low else max)(best[n, low], v)
        out.append(Rule(tuple((n, low, v) for (n, low), v in sorted(best.items()))))
    if node.getClass().getSimpleName() == "InternalNode":
        name, bound = names[node.split().featureIndex()], float(node.split().threshold())
        out += _paths(node.leftChild(), names, path + ((name, True, bound),))
        out += _paths(node.rightChild(), names, path + ((name, False, bound),))
    return out


def fit(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = SEED) -> RuleEnsemble:
    """Rules from a table of text and label (0 or 1); its size must be bounded."""
    data = saved(with_statistics(labelled.filter("label in (0, 1)")).select(F.col("label").cast("double").alias("label"), "_s.*"), "quality-sample")
    found = {r["label"]: r["n"] for r in data.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(found) < 2:  # one class or none: nothing to tell apart
        return RuleEnsemble([], [], 4.0 if 1.0 in found else -4.0 if found else 0.0)
    names = [c for c in data.columns if c != "label"]
    forest = RandomForestClassifier(featuresCol="x", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed)
    grown = forest.fit(VectorAssembler(inputCols=names, outputCol="x").transform(data))
    rules = sorted({r for t in grown.trees for r in _paths(t._java_obj.rootNode(), names)}, key=lambda r: r.parts)
    if not rules:
        share = found[1.0] / sum(found.values())
        return RuleEnsemble([], [], float(4 * share - 2))
    flags = data.select("label", *[r.column(F.col).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    flags = saved(VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="x").transform(flags).select("label", "x"), "quality-rules")
    model = LogisticRegression(featuresCol="x", elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False).fit(flags)
    kept = [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray()) if abs(w) > 1e-6]
    return RuleEnsemble([r for r, _ in kept], [w for _, w in kept], float(model.intercept))


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def training_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """text and label of at most ``size`` labelled documents outside the held-out fold.

    The ids are chosen by hash, so that only a bounded table is broadcast to the texts.
    """
    pool = labels.filter(~held_out() & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").alias("label"))
    ids = pool.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "label").limit(size)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "label")


def score(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs`` with score and predicted (replacing columns of these names).

    Null text is empty text; both get the score of their statistics. Reads text only.
    """
    docs = docs.drop("score", "predicted")
    out = with_statistics(docs).withColumn("score", model.score())
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).select(*docs.columns, "score", "predicted")
