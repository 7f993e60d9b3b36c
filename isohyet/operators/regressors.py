"""Regressions that iterate: Bayesian ridge on sums of products, and boosted
trees for counts on histograms.

Neither gathers rows. Ridge needs a group's means and covariances once, whatever
its rows. A level of a tree needs sums by (node, feature, bin), a table whose size
follows from the parameters and not from the rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..session import shared


def evidence(gram: np.ndarray, xy: np.ndarray, yy: np.ndarray, n: np.ndarray, rounds: int, tolerance: float, shape: float, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weights, noise precision, weight precision and weights' covariance of many
    small problems at once: ``gram`` m by k by k, ``xy`` m by k, of centred data.
    A problem stops when its weights move by less than ``tolerance``; both
    precisions have gamma priors of ``shape`` and ``rate``."""
    values, vectors = np.linalg.eigh(gram)
    values = np.maximum(values, 0.0)
    turned = np.einsum("mki,mk->mi", vectors, xy)
    noise, strength = 1 / (yy / n + np.finfo(float).eps), np.ones(len(n))
    weights, going = np.zeros_like(xy), np.ones(len(n), bool)
    solve = lambda: np.einsum("mki,mi->mk", vectors, turned / (values + (strength / noise)[:, None]))
    for i in range(rounds):
        new = solve()
        error = yy - 2 * (new * xy).sum(1) + np.einsum("mi,mij,mj->m", new, gram, new)
        used = (noise[:, None] * values / (strength[:, None] + noise[:, None] * values)).sum(1)
        next_strength = (used + 2 * shape) / ((new**2).sum(1) + 2 * rate)
        next_noise = (n - used + 2 * shape) / (np.maximum(error, 0.0) + 2 * rate)
        strength, noise = np.where(going, next_strength, strength), np.where(going, next_noise, noise)
        moved = np.abs(new - weights).sum(1)
        weights = np.where(going[:, None], new, weights)
        if i:
            going &= moved >= tolerance
        if not going.any():
            break
    spread = np.einsum("mai,mi,mbi->mab", vectors, 1 / (strength[:, None] + noise[:, None] * values), vectors)
    return solve(), noise, strength, spread


def bayesian_ridge(df: DataFrame, by: Sequence[str], features: Sequence[str], y: str, *, rounds: int = 300, tolerance: float = 1e-3, shape: float = 1e-4, rate: float = 1e-6) -> DataFrame:
    """A ridge regression of each group whose penalty is found by maximising the
    evidence: a row a group with ``n``, ``centre``, ``scale``, ``weights`` (of
    scaled features), ``base``, ``noise`` and ``strength`` (precisions of the
    noise and of the weights) and ``spread`` (the weights' covariance, by rows).

    Rows with a null take no part; a group of fewer than two rows has no model. A
    feature that does not vary has weight 0. One shuffle of partial sums.
    """
    known = F.lit(True)
    for c in (*features, y):
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    x = [F.col(c).cast("double") for c in features]
    t = F.col(y).cast("double")
    pairs = [F.covar_pop(a, b) for a in x for b in x]
    sums = df.where(known).groupBy(*by).agg(
        F.count("*").alias("n"), F.array(*map(F.avg, x)).alias("centre"), F.array(*pairs).alias("_xx"), F.array(*[F.covar_pop(a, t) for a in x]).alias("_xy"), F.avg(t).alias("base"), F.var_pop(t).alias("_yy")
    )
    k = len(features)
    out = sums.select(*by, "n", "centre", "base").schema
    for name in ("scale", "weights", "spread"):
        out = out.add(name, ArrayType(DoubleType()))
    out = out.add("noise", "double").add("strength", "double")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            n = pdf["n"].to_numpy(float)
            xx = np.stack([np.asarray(v, float) for v in pdf["_xx"]]).reshape(-1, k, k)
            scale = np.sqrt(np.maximum(np.diagonal(xx, axis1=1, axis2=2), 0.0))
            scale = np.where(scale > 0, scale, 1.0)
            gram = xx / scale[:, :, None] / scale[:, None, :] * n[:, None, None]
            xy = np.stack([np.asarray(v, float) for v in pdf["_xy"]]) / scale * n[:, None]
            weights, noise, strength, spread = evidence(gram, xy, pdf["_yy"].to_numpy(float) * n, n, rounds, tolerance, shape, rate)
            yield pdf.drop(columns=["_xx", "_xy", "_yy"]).assign(scale=list(scale), weights=list(weights), spread=list(spread.reshape(-1, k * k)), noise=noise, strength=strength)[[f.name for f in out]]

    return sums.where("n > 1").mapInPandas(solve, out)


def with_ridge(df: DataFrame, models: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """``prediction`` and its standard deviation ``doubt`` from each group's model;
    rows of a group without one have neither."""
    k = len(features)
    m = models.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.struct("centre", "scale", "weights", "spread", "base", "noise").alias("_m"))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    z = [(F.col(c).cast("double") - F.col("_m.centre")[i]) / F.col("_m.scale")[i] for i, c in enumerate(features)]
    guess = sum((F.col("_m.weights")[i] * v for i, v in enumerate(z)), F.col("_m.base"))
    wide = sum((F.col("_m.spread")[i * k + j] * z[i] * z[j] for i in range(k) for j in range(k)), 1 / F.col("_m.noise"))
    return df.join(m, same, "left").select(*[df[c] for c in df.columns], guess.alias("prediction"), F.sqrt(wide).alias("doubt"))


@dataclass
class Node:
    """A leaf where ``feature`` is negative. ``cut`` counts the cut points that a
    value to the left may at most exceed."""

    feature: int = -1
    cut: int = 0
    null_left: bool = True
    gain: float = 0.0
    value: float = 0.0
    children: tuple[Node, Node] | None = None


@dataclass
class BoostedCounts:
    """Trees whose summed leaves are the logarithm of an expected count."""

    features: list[str]
    cuts: list[list[float]]
    base: float
    trees: list[Node] = field(default_factory=list)

    def expected(self) -> Column:
        """The expected count of a row that has the features."""
        left = lambda f, cut: number(self.features[f]) <= self.cuts[f][cut]
        return F.exp(sum((leaf(tree, left) for tree in self.trees), F.lit(self.base)))

    def gains(self) -> dict[str, float]:
        """Loss that the splits of each feature took away."""
        out = dict.fromkeys(self.features, 0.0)
        todo = list(self.trees)
        while todo:
            node = todo.pop()
            if node.children:
                out[self.features[node.feature]] += node.gain
                todo += node.children
        return out


def number(name: str) -> Column:
    """As a double, null where it is not a number."""
    x = F.col(name).cast("double")
    return F.when(~F.isnan(x), x)


def leaf(node: Node, left: Callable[[int, int], Column], found: Callable[[Node], Column] = lambda n: F.lit(n.value)) -> Column:
    if node.children is None:
        return found(node)
    goes = F.coalesce(left(node.feature, node.cut), F.lit(node.null_left))
    return F.when(goes, leaf(node.children[0], left, found)).otherwise(leaf(node.children[1], left, found))


def drawn(key: str, turn: int, share: float) -> Column:
    """Whether a row takes part in a round, by a hash: a lost task draws the same."""
    if share >= 1:
        return F.lit(True)
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{turn}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 6), 16, 10).cast("long")
    return h % 1000 < round(share * 1000)


def columns_drawn(features: Sequence[str], turn: int, share: float) -> list[int]:
    order = sorted(range(len(features)), key=lambda i: hashlib.md5(f"{turn}:{features[i]}".encode()).hexdigest())
    return sorted(order[: max(1, math.ceil(share * len(features)))])


def poisson_boosting(
    df: DataFrame, features: Sequence[str], y: str, key: str, *, rounds: int = 20, depth: int = 3, bins: int = 32, rate: float = 0.3, ridge: float = 1.0, lasso: float = 0.1,
    least_gain: float = 0.1, least_weight: float = 3.0, max_step: float = 0.7, rows: float = 1.0, columns: float = 1.0, write_every: int = 10,
) -> BoostedCounts:
    """Boosted trees under the Poisson loss ``exp(f) - y f``.

    Features are cut into ``bins`` by approximate quantiles. Each level of a tree
    is one aggregation of gradients by (node, feature, bin), at most 2^depth x
    features x (bins + 1) rows, from which the driver takes the splits; of splits
    equal to nine places the first feature, then the least cut wins. A split must take away
    ``least_gain`` of twice the loss and leave curvature ``least_weight`` on both
    sides. Leaves are at most ``max_step`` before ``rate``; a null follows the side
    that loses less. ``rows`` and ``columns`` are the shares drawn for each round
    by a hash of ``key`` and of the names.

    Rows are written once before they are cut: cuts are values of rows, and a mean
    computed anew may differ in its last bit and so change sides. For the same
    reason rows that the model is asked about should be written, if they are means.
    Binned rows and, every ``write_every`` rounds, their sums go to the shared
    folder, too; between, the trees are one expression, so that no plan grows with the
    number of rounds. Rows whose count is null, negative or no number take no
    part; without any row, or where all counts are 0, the model is a constant 0.
    """
    if not features or bins < 2 or depth < 1:
        raise ValueError("at least one feature, two bins and one level are needed")
    features = list(features)
    count = number(y)
    data = shared(df.where(count >= 0).select(F.col(key).alias("_key"), count.alias("_y"), *[number(c).alias(f"_x{i}") for i, c in enumerate(features)]))
    at = [i / bins for i in range(1, bins)]
    first = data.agg(F.avg("_y").alias("mean"), *[F.percentile_approx(f"_x{i}", at, 10000).alias(f"c{i}") for i in range(len(features))]).first()
    cuts = [sorted(set(first[f"c{i}"] or [])) for i in range(len(features))]
    model = BoostedCounts(features, cuts, math.log(first["mean"]) if first["mean"] else -math.inf)
    if not first["mean"]:
        return model
    bin_of = lambda i: F.when(F.col(f"_x{i}").isNotNull(), F.size(F.filter(F.lit(cuts[i]).cast("array<double>"), lambda c: c < F.col(f"_x{i}")))).alias(f"_b{i}")
    table = shared(data.select("_key", "_y", *[bin_of(i) for i in range(len(features))], F.lit(model.base).alias("_f")))
    left = lambda f, cut: F.col(f"_b{f}") <= cut

    def weight(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return np.clip(-np.sign(g) * np.maximum(np.abs(g) - lasso, 0.0) / (h + ridge), -max_step, max_step)

    def won(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        w = weight(g, h)
        return -(2 * (g * w + lasso * np.abs(w)) + (h + ridge) * w * w)

    pending: list[Node] = []
    for turn in range(rounds):
        if len(pending) >= write_every:
            table = shared(table.withColumn("_f", sum((leaf(t, left) for t in pending), F.col("_f"))))
            pending = []
        f = sum((leaf(t, left) for t in pending), F.col("_f"))
        part = table.where(drawn("_key", turn, rows)).withColumn("_f", f)
        part = part.withColumns({"_g": F.exp("_f") - F.col("_y"), "_h": F.exp(F.col("_f") + max_step)})
        used = columns_drawn(features, turn, columns)
        root = Node()
        open_ = [root]
        for _ in range(depth):
            where = leaf(root, left, lambda n, open_=open_: F.lit(next((i for i, o in enumerate(open_) if o is n), -1)))
            bins_ = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f"_b{i}").alias("bin")) for i in used])
            cells = part.select(where.alias("node"), "_g", "_h", F.explode(bins_).alias("_c")).where("node >= 0")
            hist = cells.groupBy("node", "_c.feature", "_c.bin").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h")).toPandas()
            splits = best_splits(hist, [len(c) for c in cuts], won, least_gain, least_weight)
            following = []
            for i, node in enumerate(open_):
                s = splits.get(i)
                if s is None:
                    continue
                node.feature, node.cut, node.null_left, node.gain = s["feature"], s["cut"], s["null_left"], s["gain"]
                node.children = tuple(Node(value=float(rate * weight(np.float64(g), np.float64(h)))) for g, h in s["sides"])
                following += node.children
            if root.children is None and len(hist):
                total = hist[hist["feature"] == used[0]]
                root.value = float(rate * weight(total["g"].sum(), total["h"].sum()))
            open_ = following
            if not open_:
                break
        model.trees.append(root)
        pending.append(root)
    return model


def best_splits(hist: pd.DataFrame, cuts: Sequence[int], won: Callable, least_gain: float, least_weight: float) -> dict[int, dict]:
    """For each node the split that takes most of the loss away. ``hist`` has sums
    g, h by node, feature and bin; bin is null where the feature is."""
    best: dict[int, dict] = {}
    for (node, feature), rows in hist.groupby(["node", "feature"]):
        g, h = np.zeros(cuts[feature] + 1), np.zeros(cuts[feature] + 1)
        known = rows[rows["bin"].notna()]
        g[known["bin"].astype(int)], h[known["bin"].astype(int)] = known["g"], known["h"]
        missing = rows[rows["bin"].isna()]
        g0, h0 = float(missing["g"].sum()), float(missing["h"].sum())
        all_g, all_h = g.sum() + g0, h.sum() + h0
        for null_left in (True, False):
            gl, hl = np.cumsum(g)[:-1] + g0 * null_left, np.cumsum(h)[:-1] + h0 * null_left
            gr, hr = all_g - gl, all_h - hl
            gain = np.round(won(gl, hl) + won(gr, hr) - won(np.float64(all_g), np.float64(all_h)), 9)
            gain = np.where((hl >= least_weight) & (hr >= least_weight) & (gain > least_gain), gain, -np.inf)
            if len(gain) and gain.max() > best.get(node, {"gain": -np.inf})["gain"]:
                cut = int(np.argmax(gain))
                best[node] = {"feature": int(feature), "cut": cut, "null_left": null_left, "gain": float(gain[cut]), "sides": ((gl[cut], hl[cut]), (gr[cut], hr[cut]))}
    return best
