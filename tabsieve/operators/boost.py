"""Multi-class gradient boosting on histograms (M7, M8).

Every feature is cut into bins at quantiles once. A round fits one tree per
class to the gradients of the softmax loss, all trees level by level
together: each task adds its rows' gradients and hessians up per (tree,
node, feature, bin) in NumPy, one ``groupBy`` sums the tasks' histograms, and
SQL windows over bins find each node's best split

    gain = (S(GL) + S(GR) - S(G)) / 2 - gamma,  S(G) = soft(G, alpha)^2 / (H + lambda)

with GL, HL the sums left of a cut. Of two siblings only the one with fewer
rows is counted; the other is its parent less it. Rows without a value go to
the side that gains more. The driver holds trees (at most 2^depth nodes
each), never rows. Margins come from the trees inside the scan; every
``REFRESH`` rounds they are written with the rows, so that a scan goes through
no more than that many rounds' trees and nothing is lost with an executor.

Sizes: a task's histogram has classes x 2^depth x features x bins cells, which
the parameters fix and the rows don't.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import nan_to_null
from .partitioning import materialize, spread

MISSING = 0          # the bin of absent values; values lie in bins 1, 2, ...
REFRESH = 8          # rounds after which margins are written
ROWS = "x array<short>, y int, w double, k long, v boolean, m array<double>"
CELLS = "tree int, node int, feature int, bin int, g double, h double, n long"


@dataclass(frozen=True)
class BoostParams:
    """The caller's parameters (M8). ``subsample`` and ``colsample`` are
    shares of rows and columns drawn per round by hash of seed and round;
    ``patience`` rounds without a better validation loss end the fit."""
    n_estimators: int = 50
    max_depth: int = 4
    learning_rate: float = 0.3
    subsample: float = 1.0
    colsample: float = 1.0
    min_child_weight: float = 1.0
    gamma: float = 0.0
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    bins: int = 64
    patience: int = 10
    seed: int = 42

    def __post_init__(self):
        if not (self.n_estimators > 0 and 0 < self.max_depth <= 10 and self.learning_rate > 0 and 0 < self.subsample <= 1
                and 0 < self.colsample <= 1 and self.bins >= 2 and self.patience > 0
                and min(self.min_child_weight, self.gamma, self.reg_alpha, self.reg_lambda) >= 0):
            raise ValueError(f"parameters out of range: {self}")


@dataclass
class Tree:
    """Nodes by number (children of k: 2k + 1, 2k + 2): split feature (-1 in a
    leaf), cut (bins up to it go left), side of absent values, leaf value."""
    feature: np.ndarray
    cut: np.ndarray
    absent_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> "Tree":
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n), np.zeros(n))

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The node at which each row of bins rests."""
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            b = x[rows, np.maximum(f, 0)]
            left = np.where(b == MISSING, self.absent_left[at], b <= self.cut[at])
            at = np.where(inner, 2 * at + np.where(left, 1, 2), at)

    def to_lists(self) -> dict:
        return {k: v.tolist() for k, v in asdict(self).items()}

    @classmethod
    def from_lists(cls, d: dict) -> "Tree":
        return cls(np.array(d["feature"], np.int32), np.array(d["cut"], np.int32), np.array(d["absent_left"], bool),
                   np.array(d["value"], float), np.array(d["gain"], float))


@dataclass
class BoostedModel:
    """Bin borders per feature, labels in order, and rounds of one tree per
    class; ``best`` rounds are used."""
    features: list[str]
    borders: list[list[float]]
    labels: list[str]
    params: BoostParams
    rounds: list[list[Tree]] = field(default_factory=list)
    best: int = 0

    def margins(self, x: np.ndarray, rounds: int | None = None, base: np.ndarray | None = None, start: int = 0) -> np.ndarray:
        """Sums of the trees' values; ``base`` holds those of the rounds
        before ``start``."""
        out = np.zeros((len(x), len(self.labels))) if base is None else base.copy()
        for trees in self.rounds[start:self.best if rounds is None else rounds]:
            for c, tree in enumerate(trees):
                out[:, c] += tree.value[tree.nodes(x)]
        return out

    def importances(self) -> list[tuple[str, float, int]]:
        """(feature, share of the gain of all splits used, number of splits)."""
        gain, used = np.zeros(len(self.features)), np.zeros(len(self.features), int)
        for tree in (t for trees in self.rounds[:self.best] for t in trees):
            inner = tree.feature >= 0
            np.add.at(gain, tree.feature[inner], tree.gain[inner])
            np.add.at(used, tree.feature[inner], 1)
        return [(f, float(g / (gain.sum() or 1.0)), int(n)) for f, g, n in zip(self.features, gain, used)]

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "borders": self.borders, "labels": self.labels, "params": asdict(self.params),
                           "best": self.best, "rounds": [[t.to_lists() for t in r] for r in self.rounds]})

    @classmethod
    def from_json(cls, s: str) -> "BoostedModel":
        d = json.loads(s)
        return cls(d["features"], d["borders"], d["labels"], BoostParams(**d["params"]),
                   [[Tree.from_lists(t) for t in r] for r in d["rounds"]], d["best"])


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def quantile_borders(df: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Borders between bins at approximate quantiles, one aggregate for all
    features; fewer where values repeat, none for a column without values."""
    x = [nan_to_null(F.col(f"`{f}`").cast("double")) for f in features]
    at = [i / (bins - 1) for i in range(1, bins - 1)] or [0.5]
    row = df.agg(*[F.percentile_approx(c, at, 10_000).alias(f"q{i}") for i, c in enumerate(x)]).first()
    return [sorted(set(row[f"q{i}"] or ())) for i in range(len(x))]


def binned(x: np.ndarray, borders: Sequence[Sequence[float]]) -> np.ndarray:
    """Bin 0 for an absent value, else 1 + the number of borders below it."""
    out = np.empty(x.shape, np.int16)
    for f, b in enumerate(borders):
        out[:, f] = np.where(np.isnan(x[:, f]), MISSING, 1 + np.searchsorted(b, x[:, f], side="left"))
    return out


def _draw(keys: np.ndarray, seed: int, round_: int) -> np.ndarray:
    """A number in [0, 1) per row hash, anew in every round."""
    z = keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 1_000_003 + round_ + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(m)
    return (z ^ (z >> np.uint64(31))).astype(np.float64) / 2.0 ** 64


def _columns(pdf: pd.DataFrame, p: int) -> np.ndarray:
    return np.vstack(pdf["x"].to_numpy()).reshape(-1, p).astype(np.int16) if len(pdf) else np.zeros((0, p), np.int16)


def _base(pdf: pd.DataFrame, k: int) -> np.ndarray:
    return np.vstack(pdf["m"].to_numpy()).reshape(-1, k).astype(float)


def prepared(df: DataFrame, features: Sequence[str], borders, label: str, labels: Sequence[str], weight: str | None,
             key: Sequence[str], validation: str | None) -> DataFrame:
    """(x: bins, y: class number, w, k: row hash, v: validation row, m: margins
    so far), written to the shared folder. Rows without a known label are left
    out."""
    p = len(features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = binned(pdf[[f"x{i}" for i in range(p)]].to_numpy(dtype="float64", na_value=np.nan), borders)
            yield pd.DataFrame({"x": list(x), "y": pdf["y"], "w": pdf["w"], "k": pdf["k"], "v": pdf["v"],
                                "m": list(np.zeros((len(pdf), len(labels))))})

    y = F.array_position(F.array(*[F.lit(c) for c in labels]), F.col(label).cast("string")) - 1
    cols = [nan_to_null(F.col(f"`{f}`").cast("double")).alias(f"x{i}") for i, f in enumerate(features)]
    rows = df.filter(F.col(label).cast("string").isin(list(labels))).select(
        *cols, y.cast("int").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
        F.xxhash64(*key).alias("k"), (F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)).alias("v"))
    return spread(materialize(spread(rows).mapInPandas(run, ROWS), "boost-rows"))


def with_margins(rows: DataFrame, model: BoostedModel, start: int) -> DataFrame:
    """``rows`` with the margins of all rounds, written anew."""
    p, k = len(model.features), len(model.labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(m=list(model.margins(_columns(pdf, p), len(model.rounds), _base(pdf, k), start)))

    return spread(materialize(rows.mapInPandas(run, ROWS), "boost-rows"))


def _histograms(model: BoostedModel, growing: list[Tree], nodes: Sequence[tuple[int, int]], cols: Sequence[int], width: int, start: int):
    """Cells of the given (tree, node) pairs over a task's training rows."""
    par, k, p, done = model.params, len(model.labels), len(model.features), len(model.rounds)
    slot = {tn: i for i, tn in enumerate(nodes)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = len(nodes) * len(cols) * width
        total = np.zeros((3, size))
        for pdf in batches:
            drawn = _draw(pdf["k"].to_numpy(), par.seed, done) < par.subsample
            pdf = pdf[drawn & ~pdf["v"].to_numpy(dtype=bool)]
            if not len(pdf):
                continue
            x, y, w = _columns(pdf, p), pdf["y"].to_numpy(), pdf["w"].to_numpy(dtype=float)
            prob = softmax(model.margins(x, done, _base(pdf, k), start))
            for c in range(k):
                g = w * (prob[:, c] - (y == c))
                h = w * prob[:, c] * (1.0 - prob[:, c])
                at = growing[c].nodes(x)
                s = np.full(len(growing[c].feature), -1, np.int64)
                for (tree, node), i in slot.items():
                    if tree == c:
                        s[node] = i
                use = s[at] >= 0
                if not use.any():
                    continue
                cell = ((s[at][use, None] * len(cols) + np.arange(len(cols))) * width + x[use][:, cols]).ravel()
                for i, v in enumerate((g, h, np.ones(len(g)))):
                    total[i] += np.bincount(cell, weights=np.repeat(v[use], len(cols)), minlength=size)
        cell = np.flatnonzero(total[2])
        which, rest = np.divmod(cell, len(cols) * width)
        f, b = np.divmod(rest, width)
        tn = np.array(nodes, np.int32).reshape(-1, 2)
        yield pd.DataFrame({"tree": tn[which, 0], "node": tn[which, 1], "feature": np.array(cols, np.int32)[f], "bin": b.astype("int32"),
                            "g": total[0][cell], "h": total[1][cell], "n": total[2][cell].astype("int64")})
    return run


def sibling_cells(counted: DataFrame, parents: DataFrame) -> DataFrame:
    """Cells of the siblings of all nodes in ``counted``: their parents' less
    theirs."""
    parent = ((F.col("node") - 1) / 2).cast("int")
    less = counted.select("tree", parent.alias("up"), "feature", "bin", *[(-F.col(c)).alias(c) for c in "ghn"],
                          F.col("node").alias("side"))
    sides = less.select("tree", "up", "side").distinct()
    whole = parents.withColumnRenamed("node", "up").join(F.broadcast(sides), ["tree", "up"])    # at most a row a node
    both = whole.select("tree", "up", "side", "feature", "bin", "g", "h", "n").unionByName(less.select("tree", "up", "side", "feature", "bin", "g", "h", "n"))
    other = (F.lit(4) * F.col("up") + 3 - F.col("side")).alias("node")      # 2k + 1 and 2k + 2 sum to 4k + 3
    return both.groupBy("tree", other.cast("int").alias("node"), "feature", "bin").agg(
        *[F.sum(c).alias(c) for c in "ghn"]).filter(F.col("n") > 0)


def score(g, h, alpha: float, lam: float):
    """soft(g, alpha)^2 / (h + lambda), 0 where nothing is below it."""
    soft = F.greatest(F.abs(g) - F.lit(alpha), F.lit(0.0))
    return F.when(h + F.lit(lam) > 0, soft * soft / (h + F.lit(lam))).otherwise(0.0)


def best_splits(cells: DataFrame, par: BoostParams) -> DataFrame:
    """(tree, node, g, h, n, feature, cut, absent_left, gain, sums of both
    sides) of each node, with a null feature where no cut gains anything. Ties go to the least feature
    and cut, absent values left."""
    of = Window.partitionBy("tree", "node", "feature")
    upto = of.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    value, absent = F.col("bin") != MISSING, F.col("bin") == MISSING
    run = cells.select("tree", "node", "feature", "bin",
                       *[F.sum(c).over(of).alias(f"{c}_all") for c in "ghn"],
                       *[F.sum(F.when(absent, F.col(c)).otherwise(0)).over(of).alias(f"{c}_absent") for c in "ghn"],
                       *[F.sum(F.when(value, F.col(c)).otherwise(0)).over(upto).alias(f"{c}_low") for c in "ghn"])
    side = F.explode(F.array(F.lit(True), F.lit(False)))
    run = run.select("*", side.alias("absent_left"))
    for c in "ghn":
        run = run.withColumn(f"{c}_left", F.col(f"{c}_low") + F.when(F.col("absent_left"), F.col(f"{c}_absent")).otherwise(0))
        run = run.withColumn(f"{c}_right", F.col(f"{c}_all") - F.col(f"{c}_left"))
    s = lambda side_: score(F.col(f"g_{side_}"), F.col(f"h_{side_}"), par.reg_alpha, par.reg_lambda)
    gain = (s("left") + s("right") - s("all")) / 2 - F.lit(par.gamma)
    fits = ((F.col("n_left") > 0) & (F.col("n_right") > 0) & (F.col("h_left") >= par.min_child_weight)
            & (F.col("h_right") >= par.min_child_weight))
    run = run.withColumn("gain", F.when(fits, gain))
    order = F.struct(F.coalesce(F.round("gain", 9), F.lit(-1.0)).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"),
                     F.col("absent_left").alias("l"), F.col("gain").alias("exact"),
                     *[f"{c}_{side_}" for side_ in ("left", "right") for c in "ghn"])
    top = run.groupBy("tree", "node").agg(F.max(order).alias("t"), F.max_by("g_all", -F.col("feature")).alias("g"),
                                          F.max_by("h_all", -F.col("feature")).alias("h"), F.max("n_all").alias("n"))
    ok = F.col("t.exact") > 0
    return top.select("tree", "node", "g", "h", "n", F.when(ok, -F.col("t.f")).alias("feature"), F.when(ok, -F.col("t.b")).alias("cut"),
                      F.col("t.l").alias("absent_left"), F.when(ok, F.col("t.exact")).alias("gain"),
                      *[f"t.{c}_{side_}" for side_ in ("left", "right") for c in "gh"],
                      (F.col("t.n_left") <= F.col("t.n_right")).alias("left_is_less"))


def _leaf(g: float, h: float, par: BoostParams) -> float:
    soft = np.sign(g) * max(abs(g) - par.reg_alpha, 0.0)
    return float(-par.learning_rate * soft / (h + par.reg_lambda)) if h + par.reg_lambda > 0 else 0.0


def grow(rows: DataFrame, model: BoostedModel, start: int) -> list[Tree]:
    """One round's trees, all classes a level at a time. The sums
    beside a node's cut give its children's values, so the lowest level is not
    counted."""
    par, p = model.params, len(model.features)
    draw = np.random.default_rng([par.seed, len(model.rounds)])
    cols = sorted(draw.choice(p, max(1, round(p * par.colsample)), replace=False).tolist())
    width = 2 + max(map(len, model.borders))
    trees = [Tree.empty(par.max_depth) for _ in model.labels]
    counted, cells = [(c, 0) for c in range(len(trees))], None
    for _ in range(par.max_depth):
        parts = rows.mapInPandas(_histograms(model, trees, counted, cols, width, start), CELLS)
        mine = parts.groupBy("tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"])
        mine = materialize(mine, "boost-counted")
        cells = mine if cells is None else materialize(mine.unionByName(sibling_cells(mine, cells)), "boost-cells")
        counted = []
        for r in best_splits(cells, par).collect():       # at most 2^depth nodes per class
            t, k = trees[r["tree"]], r["node"]
            if r["feature"] is None:
                t.value[k] = _leaf(r["g"], r["h"], par)
                continue
            t.feature[k], t.cut[k], t.absent_left[k], t.gain[k] = r["feature"], r["cut"], r["absent_left"], r["gain"]
            t.value[2 * k + 1], t.value[2 * k + 2] = _leaf(r["g_left"], r["h_left"], par), _leaf(r["g_right"], r["h_right"], par)
            counted.append((r["tree"], 2 * k + 1 if r["left_is_less"] else 2 * k + 2))
        if not counted:
            break
        counted.sort()
    return trees


def losses(rows: DataFrame, model: BoostedModel, start: int) -> dict[bool, float]:
    """Weighted mean log loss of all rounds so far, on validation rows (True)
    and training rows (False)."""
    p, k = len(model.features), len(model.labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                prob = softmax(model.margins(_columns(pdf, p), len(model.rounds), _base(pdf, k), start))
                own = prob[np.arange(len(pdf)), pdf["y"].to_numpy()]
                yield pd.DataFrame({"v": pdf["v"], "w": pdf["w"], "l": -np.log(np.maximum(own, 1e-15)) * pdf["w"].to_numpy(dtype=float)})

    out = rows.mapInPandas(run, "v boolean, w double, l double").groupBy("v").agg((F.sum("l") / F.sum("w")).alias("l")).collect()
    return {r["v"]: float(r["l"]) for r in out}


def fit(df: DataFrame, features: Sequence[str], label: str, key: Sequence[str], params: BoostParams = BoostParams(),
        weight: str | None = None, validation: str | None = None) -> tuple[BoostedModel, list[tuple[int, float, float | None]]]:
    """The model and (round, training loss, validation loss) of every round.

    ``validation`` names a boolean column; its true rows are only measured,
    and the rounds up to the least validation loss are kept. Null and NaN
    values are absent values; rows without a label are not learned; one class
    or an empty table gives a model without trees.
    """
    train = df.filter(~F.coalesce(F.col(validation), F.lit(False))) if validation else df
    labels = sorted(r[0] for r in train.select(F.col(label).cast("string")).distinct().collect() if r[0] is not None)
    model = BoostedModel(list(features), [], labels, params)
    if len(labels) < 2:
        return model, []
    model.borders = quantile_borders(train, features, params.bins)
    rows = prepared(df, features, model.borders, label, labels, weight, key, validation)
    history, start = [], 0
    for i in range(params.n_estimators):
        model.rounds.append(grow(rows, model, start))
        got = losses(rows, model, start)
        history.append((i + 1, got.get(False), got.get(True)))
        watched = [h[2] if h[2] is not None else h[1] for h in history]
        model.best = 1 + int(np.argmin(watched)) if validation else i + 1
        if validation and i + 1 - model.best >= params.patience:
            break
        if i + 1 - start >= REFRESH:
            rows, start = with_margins(rows, model, start), i + 1
    return model, history


def predict(model: BoostedModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` with predicted, confidence (greatest probability) and one
    ``prob_`` column per class. A model without classes predicts null."""
    feats, p, labels = model.features, len(model.features), model.labels
    x = [(nan_to_null(F.col(f"`{f}`").cast("double")) if f in df.columns else F.lit(None).cast("double")).alias(f"__x{i}") for i, f in enumerate(feats)]
    kept = df.select(*[F.col(f"`{k}`") for k in keep])
    if not labels:
        return kept.withColumns({"predicted": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    schema = kept.schema.add("predicted", "string").add("confidence", "double")
    for c in labels:
        schema = schema.add(f"prob_{c}", "double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = pdf[[f"__x{i}" for i in range(p)]].to_numpy(dtype="float64", na_value=np.nan)
            bins = binned(raw, model.borders) if model.rounds else np.zeros(raw.shape, np.int16)
            prob = softmax(model.margins(bins))
            out = pdf[list(keep)].copy()
            out["predicted"] = np.array(labels, object)[prob.argmax(axis=1)]
            out["confidence"] = prob.max(axis=1)
            for i, c in enumerate(labels):
                out[f"prob_{c}"] = prob[:, i]
            yield out

    return df.select(*[F.col(f"`{k}`") for k in keep], *x).mapInPandas(run, schema)
