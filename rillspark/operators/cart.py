"""Classification trees with exact Gini splits, and their reports.

A level of the tree is one pass: each feature's values of every open node, counted by class, are dealt out in ranges of
(node, feature, value); sums within a range go on from those of the ranges before it, so all splits between neighbouring
values are scored exactly, whatever the size of a node. The driver holds the tree alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import stored


@dataclass
class Node:
    """Training rows by class, and the split (feature, threshold: rows up to it go left) unless it is a leaf."""

    counts: list[int]
    feature: int | None = None
    threshold: float | None = None

    def impurity(self) -> float:
        n = sum(self.counts)
        return 1 - sum(c * c for c in self.counts) / (n * n) if n else 0.0


@dataclass
class Tree:
    """A fitted tree (nodes by number, those below i are 2i and 2i + 1), predictions of the test rows (label, predicted) and
    features by importance."""

    features: list[str]
    classes: list[str]
    nodes: dict[int, Node] = field(default_factory=dict)
    predictions: DataFrame | None = None
    importances: DataFrame | None = None

    def _class(self, i: int) -> str:
        counts = self.nodes[i].counts
        return self.classes[counts.index(max(counts))]

    def text(self, at: int = 1, depth: int = 0) -> str:
        """A line for each split and leaf, indented by depth."""
        if not self.nodes:
            return ""
        node, pad = self.nodes[at], "|   " * depth + "|--- "
        if node.feature is None:
            return f"{pad}class: {self._class(at)}"
        name = self.features[node.feature]
        return "\n".join([f"{pad}{name} <= {node.threshold:.2f}", self.text(2 * at, depth + 1), f"{pad}{name} >  {node.threshold:.2f}", self.text(2 * at + 1, depth + 1)])

    def node_of(self, x: Column) -> Column:
        """The number of the last node that a row's features lead to."""
        at = F.lit(1)
        for level in range(max(self.nodes, default=1).bit_length()):
            step = None
            for i, node in self.nodes.items():
                if i.bit_length() == level + 1 and node.feature is not None:
                    to = F.when(F.get(x, F.lit(node.feature)) <= node.threshold, 2 * i).otherwise(2 * i + 1)
                    step = F.when(at == i, to) if step is None else step.when(at == i, to)
            at = at if step is None else step.otherwise(at)
        return at

    def shares(self) -> list[tuple[str, float]]:
        """Features by the impurity that their splits take away, largest first; all together 1, unless nothing is split."""
        gain = [0.0] * len(self.features)
        for i, node in self.nodes.items():
            if node.feature is not None:
                parts = [self.nodes[2 * i], self.nodes[2 * i + 1]]
                gain[node.feature] += sum(node.counts) * node.impurity() - sum(sum(p.counts) * p.impurity() for p in parts)
        total = sum(gain) or 1.0
        return sorted(((f, g / total) for f, g in zip(self.features, gain, strict=True)), key=lambda x: -x[1])


def confusion(predictions: DataFrame) -> DataFrame:
    """label, predicted, n."""
    return predictions.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def report(predictions: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support of each class that occurs; null precision without predictions."""
    cells = confusion(predictions)
    hit = F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0))
    by_label = cells.groupBy("label").agg(F.sum("n").alias("support"), hit.alias("hit"))
    by_guess = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("guessed"))
    precision, recall = F.try_divide("hit", "guessed"), F.try_divide("hit", "support")
    both = by_label.join(by_guess, "label", "left")
    return both.select("label", precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * precision * recall, precision + recall).alias("f1"), "support")


def best_splits(rows: DataFrame, classes: int, leaf: int) -> DataFrame:
    """node, f, v, after, l0.. of rows (node, y, x): each node's best split, between the neighbouring values v and after of
    feature f, and the rows by class on its left. Both sides have leaf rows at least; of equal splits the lowest feature and
    value count. Nodes without such a split have no row."""
    names = [f"c{k}" for k in range(classes)]
    items = rows.select("node", "y", F.posexplode("x").alias("f", "v")).groupBy("node", "f", "v").agg(*[F.count_if(F.col("y") == k).alias(c) for k, c in enumerate(names)])
    ranged = stored(items.repartitionByRange("node", "f", "v").withColumn("part", F.spark_partition_id()), "cart")
    by_part = Window.partitionBy("node", "f").orderBy("part")  # a row for each range
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    heads = ranged.groupBy("part", "node", "f").agg(F.min("v").alias("low"), *[F.sum(c).alias(c) for c in names])
    heads = heads.select("part", "node", "f", F.lead("low").over(by_part).alias("next"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"o{c}") for c in names])
    own = Window.partitionBy("part", "node", "f").orderBy("v")
    scan = ranged.join(heads, ["part", "node", "f"]).select("node", "f", "v", F.coalesce(F.lead("v").over(own), F.col("next")).alias("after"), *[(F.col(f"o{c}") + F.sum(c).over(own)).alias(f"l{k}") for k, c in enumerate(names)])
    totals = rows.groupBy("node").agg(*[F.count_if(F.col("y") == k).alias(f"t{k}") for k in range(classes)])
    left = sum((F.col(f"l{k}") for k in range(classes)), F.lit(0))
    right = sum((F.col(f"t{k}") - F.col(f"l{k}") for k in range(classes)), F.lit(0))
    squares = lambda f: sum((f(k) * f(k) for k in range(classes)), F.lit(0)).cast("double")
    score = squares(lambda k: F.col(f"l{k}")) / left + squares(lambda k: F.col(f"t{k}") - F.col(f"l{k}")) / right  # the higher, the purer
    fit = scan.filter("after is not null").join(totals, "node").filter((left >= leaf) & (right >= leaf))
    kept = F.struct("f", "v", "after", *[f"l{k}" for k in range(classes)])
    return fit.groupBy("node").agg(F.min_by(kept, F.struct((-score).alias("s"), "f", "v")).alias("b")).select("node", "b.*")


def cart(df: DataFrame, label: str, features: list[str], test: Column, depth: int = 5, leaf: int = 5) -> Tree:
    """A Gini tree fitted on the rows outside test; rows with nulls in what it needs are left out.

    A node is split while it is impure, has a split with leaf rows on both sides and is above depth. Thresholds are in the
    middle of the values they divide. Without training rows there is no tree, and there are no predictions.
    """
    rows = df.select(F.col(label).cast("string").alias("label"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"), test.alias("_test"))
    rows = stored(rows.filter(F.col("label").isNotNull() & F.col("_test").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))), "cart-rows")
    train = rows.filter("not _test")
    counted = sorted((r["label"], r["count"]) for r in train.groupBy("label").count().collect())  # a row for each class
    tree = Tree(features, [c for c, _ in counted])
    if counted:
        tree.nodes[1] = Node([n for _, n in counted])
    y = F.array_position(F.array(*[F.lit(c) for c in tree.classes]), F.col("label")).cast("int") - 1 if counted else F.lit(0)
    for level in range(depth):
        going = [i for i, node in tree.nodes.items() if i.bit_length() == level + 1 and node.impurity() > 0]
        if not going:
            break
        open_ = train.select(tree.node_of(F.col("x")).alias("node"), y.alias("y"), "x").filter(F.col("node").isin(going))
        for r in best_splits(open_, len(counted), leaf).collect():  # a row for each node
            node, low = tree.nodes[r["node"]], [r[f"l{k}"] for k in range(len(counted))]
            middle = r["v"] / 2 + r["after"] / 2
            node.feature, node.threshold = r["f"], middle if middle < r["after"] else r["v"]
            tree.nodes[2 * r["node"]], tree.nodes[2 * r["node"] + 1] = Node(low), Node([t - x for t, x in zip(node.counts, low, strict=True)])
    leaves = [i for i, node in tree.nodes.items() if node.feature is None]
    guess = F.element_at(F.create_map(*[x for i in leaves for x in (F.lit(i), F.lit(tree._class(i)))]), tree.node_of(F.col("x"))) if leaves else F.lit(None).cast("string")
    tree.predictions = rows.filter(F.col("_test") & F.lit(bool(leaves))).select("label", guess.alias("predicted"))
    tree.importances = df.sparkSession.createDataFrame(tree.shares(), "feature string, importance double")
    return tree
