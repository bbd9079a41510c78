"""Classification trees whose cuts are found among all values of all rows.

The tree grows level by level. At each level the rows of every open node are counted per (node, predictor, value): equal
values shrink to one row where they lie. The values are sorted over the whole table by (node, predictor, value) and written once;
a running sum of rows and responses is the sum within the sorted slice plus the sums of the slices before it, so a predictor
may have as many distinct values as the table has rows. Each gap between two neighbouring values is a possible cut. The
levels of a text predictor are cut off one at a time and need no order.

The driver holds the tree, at most 2^depth nodes, and sees one best cut per open node and level.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patronage.operators.ranking import ROW_BITS
from patronage.scratch import stored

# A cut must lower the impurity by more than rounding does.
LEAST_GAIN = 1e-12


@dataclass
class Node:
    """A node of the tree: a leaf, or a cut of ``predictor`` at ``threshold`` (numbers) or of ``level`` (texts)."""

    rows: int
    responses: int
    depth: int
    predictor: str | None = None
    threshold: float | None = None
    level: str | None = None
    gain: float = 0.0
    left: Node | None = None
    right: Node | None = None

    @property
    def probability(self) -> float:
        return self.responses / self.rows

    @property
    def term(self) -> str:
        return self.predictor if self.level is None else f"{self.predictor}_{self.level}"


def _leaf(node: Node, values: dict[str, Column], found) -> Column:
    """``found(leaf)`` of the leaf a row belongs to."""
    if node.predictor is None:
        return F.lit(found(node))
    goes_left = values[node.predictor] <= F.lit(node.threshold) if node.level is None \
        else values[node.predictor] != F.lit(node.level)
    return F.when(goes_left, _leaf(node.left, values, found)).otherwise(_leaf(node.right, values, found))


def _running(counts: DataFrame) -> DataFrame:
    """(node, place, value, next, n1, k1, rows, responses): sums up to each value, in the order of values."""
    by = ["node", "place"]
    ordered = stored(counts.orderBy(*by, "value").withColumn("_row", F.monotonically_increasing_id()), "cuts").withColumn(
        "_slice", F.shiftright("_row", ROW_BITS))
    # One row per slice and predictor, a few more than there are slices.
    slices = ordered.groupBy("_slice", *by).agg(F.sum("n").alias("_n"), F.sum("k").alias("_k"), F.min("value").alias("_least"))
    own, whole = W.partitionBy(*by).orderBy("_slice"), W.partitionBy(*by)
    slices = slices.select(
        "_slice", *by, (F.sum("_n").over(own) - F.col("_n")).alias("_n0"), (F.sum("_k").over(own) - F.col("_k")).alias("_k0"),
        F.lead("_least").over(own).alias("_after"), F.sum("_n").over(whole).alias("rows"), F.sum("_k").over(whole).alias("responses"))
    inside = W.partitionBy("_slice", *by).orderBy("value")
    up_to = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = ordered.select("_slice", *by, "value", F.sum("n").over(up_to).alias("_n1"), F.sum("k").over(up_to).alias("_k1"),
                            F.lead("value").over(inside).alias("_next"))
    return summed.join(slices, ["_slice", *by]).select(
        *by, "value", F.coalesce("_next", "_after").alias("next"), (F.col("_n0") + F.col("_n1")).alias("n1"),
        (F.col("_k0") + F.col("_k1")).alias("k1"), "rows", "responses")


def _best(rows: DataFrame, node: Column, label: Column, numbers: dict[str, Column], texts: dict[str, Column],
          fewest: int) -> list:
    """One row per open node with its best cut: least impurity, then the earliest predictor, value and level."""
    kept = rows.select(node.alias("node"), label.cast("long").alias("k"), *[c.alias(f"v{i}") for i, c in enumerate(numbers.values())],
                       *[c.alias(f"t{i}") for i, c in enumerate(texts.values())]).where("node >= 0")
    found = []
    if numbers:
        long = kept.select("node", "k", F.posexplode(F.array(*[F.col(f"v{i}") for i in range(len(numbers))])).alias("place", "value"))
        counts = long.groupBy("node", "place", "value").agg(F.count("*").alias("n"), F.sum("k").alias("k"))
        found.append(_running(counts).where(F.col("next").isNotNull()).withColumn("level", F.lit(None).cast("string")))
    if texts:
        long = kept.select("node", "k", F.posexplode(F.array(*[F.col(f"t{i}") for i in range(len(texts))])).alias("at", "level"))
        counts = long.groupBy("node", "at", "level").agg(F.count("*").alias("n"), F.sum("k").alias("k"))
        totals = kept.groupBy("node").agg(F.count("*").alias("rows"), F.sum("k").alias("responses"))
        # The level goes right, as a 0/1 column above one half does.
        found.append(counts.join(F.broadcast(totals), "node").select(
            "node", (F.col("at") + len(numbers)).alias("place"), F.lit(0.0).alias("value"), F.lit(1.0).alias("next"),
            (F.col("rows") - F.col("n")).alias("n1"), (F.col("responses") - F.col("k")).alias("k1"), "rows", "responses", "level"))
    cuts = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    n1, k1, n, k = (F.col(c).cast("double") for c in ("n1", "k1", "rows", "responses"))
    # n p (1 - p) = k - k²/n, so the impurity is least where the sum of k²/n is largest.
    score = k1 * k1 / n1 + (k - k1) * (k - k1) / (n - n1)
    cuts = cuts.where((F.col("n1") >= fewest) & (F.col("rows") - F.col("n1") >= fewest)).withColumn("gain", score - k * k / n).where(
        F.col("gain") > LEAST_GAIN * k * k / n)
    return cuts.groupBy("node").agg(F.min(F.struct(
        (-score).alias("order"), "place", "value", "level", "next", "n1", "k1", "rows", "responses", "gain")).alias("cut")).select(
        "node", "cut.*").collect()


def grow(rows: DataFrame, label: str, numbers: dict[str, Column], texts: dict[str, Column], max_depth: int, fewest: int) -> Node:
    """The tree of the rows that have a label. ``numbers`` and ``texts`` give each predictor's value without nulls."""
    values = numbers | texts
    names = list(values)
    known = rows.where(F.col(label).isNotNull())
    start = known.agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("k")).first()
    root = Node(start["n"], start["k"], 0)
    open_ = [root]
    for depth in range(max_depth):
        open_ = [x for x in open_ if x.rows >= 2 * fewest and 0 < x.responses < x.rows]
        if not open_:
            break
        # Rows of nodes that are finished get -1 and are left out.
        number = {id(x): i for i, x in enumerate(open_)}
        node = _leaf(root, values, lambda x: number.get(id(x), -1))
        cuts = _best(known, node, F.col(label), numbers, texts, fewest)
        grown = []
        for c in cuts:
            x = open_[c["node"]]
            x.predictor, x.level, x.gain = names[c["place"]], c["level"], c["gain"]
            x.threshold = (c["value"] + c["next"]) / 2
            x.left = Node(c["n1"], c["k1"], depth + 1)
            x.right = Node(c["rows"] - c["n1"], c["responses"] - c["k1"], depth + 1)
            grown += [x.left, x.right]
        open_ = grown
    return root


def score(node: Node, values: dict[str, Column]) -> Column:
    return _leaf(node, values, lambda x: x.probability)


def rules(node: Node) -> str:
    """The tree as indented lines."""
    bar = "|   " * node.depth + "|--- "
    if node.predictor is None:
        return f"{bar}probability: {node.probability:.4f} (class: {int(node.probability > 0.5)})"
    return "\n".join([f"{bar}{node.term} <= {node.threshold:.4f}", rules(node.left),
                      f"{bar}{node.term} > {node.threshold:.4f}", rules(node.right)])


def gains(node: Node) -> dict[str, float]:
    """Share of the whole fall of impurity per term that is cut."""
    out: dict[str, float] = {}

    def walk(x: Node) -> None:
        if x.predictor is not None:
            out[x.term] = out.get(x.term, 0.0) + x.gain
            walk(x.left)
            walk(x.right)

    walk(node)
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def text_levels(rows: DataFrame, columns: Sequence[str], text) -> DataFrame:
    """(column, level, n): the levels of the text predictors."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), text(c).alias("level")) for c in columns])).alias("p"))
    return long.select("p.*").where(F.col("level").isNotNull()).groupBy("column", "level").agg(F.count("*").alias("n"))
