"""Text quality by a sparse ensemble of rules.

Statistics of a text are Spark expressions. Small regression trees are boosted on a bounded sample of labelled rows, every
path from a root to a node becomes a rule (a conjunction of comparisons), and a logistic model with a lasso penalty
chooses and weighs rules and a few linear terms. What has weight is compiled back into one Spark column expression, so
scoring needs no Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmill.llm.common import WHITE, WORD, whole_text

#: At most so many labelled rows are used to fit; they are drawn by the hash of doc_id.
SAMPLE_ROWS = 20_000


def statistics(text: Column) -> dict[str, Column]:
    """What rules speak about; all are finite for every text, the empty one included."""
    chars = F.length(text)
    words = F.regexp_count(text, F.lit(WORD))
    lines = F.split(text, "\n")
    distinct = lambda a: F.size(F.array_distinct(a)) / F.greatest(F.size(a), F.lit(1))
    count = lambda signs: chars - F.length(F.translate(text, signs, ""))
    letters = F.length(F.regexp_replace(text, "[^\\p{L}]+", ""))
    per = lambda a, b: a / F.greatest(b, F.lit(1))
    return {
        "chars": F.log1p(chars),
        "words": F.log1p(words),
        "word_length": per(chars, words),
        "letters": per(letters, chars),
        "capitals": per(F.length(F.regexp_replace(text, "[^\\p{Lu}]+", "")), letters),
        "signs": per(count("*$#%&@^~_=<>{}[]\\+"), words),
        "shouts": per(count("!?"), words),
        "bars": per(count("|"), words),
        "stops": per(count(".,;:"), words),
        "digits": per(count("0123456789"), chars),
        "repeats": per(F.regexp_count(text, F.lit("(?<!\\S)(\\S++)\\s++\\1(?!\\S)")), words),
        "distinct_words": distinct(F.split(text, WHITE)),
        "distinct_lines": distinct(lines),
        "line_length": F.log1p(per(chars, F.size(lines))),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, at least or below, bound)."""

    terms: tuple[tuple[str, bool, float], ...]

    def holds(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([(columns[c] >= b) == up for c, up, b in self.terms])

    def column(self, columns: dict[str, Column]) -> Column:
        each = [columns[c] >= F.lit(b) if up else columns[c] < F.lit(b) for c, up, b in self.terms]
        return reduce(Column.__and__, each)


@dataclass
class Ensemble:
    """Intercept, weighted rules, and weighted linear terms (weight, lowest, highest) by statistic."""

    intercept: float = 0.0
    rules: list[tuple[float, Rule]] = field(default_factory=list)
    linear: dict[str, tuple[float, float, float]] = field(default_factory=dict)

    def column(self, columns: dict[str, Column]) -> Column:
        """The score as a Spark expression over columns of statistics."""
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            total = total + F.when(rule.column(columns), F.lit(weight)).otherwise(F.lit(0.0))
        for name, (weight, low, high) in self.linear.items():
            total = total + F.lit(weight) * F.least(F.greatest(columns[name], F.lit(low)), F.lit(high))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _tree(codes: np.ndarray, cuts: list[np.ndarray], target: np.ndarray, depth: int, least: int) -> tuple[list, np.ndarray]:
    """(paths of all nodes but the root, fitted values) of a regression tree over binned statistics.

    A path is a tuple of (statistic number, at least, bound).
    """
    value, paths, open_nodes = np.zeros(len(target)), [], [((), np.arange(len(target)))]
    while open_nodes:
        path, rows = open_nodes.pop()
        value[rows] = target[rows].mean()
        best = (1e-9, None, None)
        if len(path) < depth and len(rows) >= 2 * least:
            whole, n = target[rows].sum(), len(rows)
            for j, bounds in enumerate(cuts):
                if not len(bounds):
                    continue
                size = np.bincount(codes[rows, j], minlength=len(bounds) + 1)[:-1].cumsum()
                total = np.bincount(codes[rows, j], target[rows], len(bounds) + 1)[:-1].cumsum()
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = total**2 / size + (whole - total) ** 2 / (n - size) - whole**2 / n
                gain[(size < least) | (n - size < least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
        _, j, k = best
        if j is not None:
            up = codes[rows, j] > k
            for side in (True, False):
                below = (*path, (j, side, float(cuts[j][k])))
                paths.append(below)
                open_nodes.append((below, rows[up == side]))
    return paths, value


def _lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int) -> tuple[float, np.ndarray]:
    """(intercept, weights) by accelerated proximal gradient steps."""
    n = len(y)
    step = 4.0 / (np.linalg.eigvalsh((x.T @ x).astype(float))[-1] / n + 1.0)
    w = v = np.zeros(x.shape[1] + 1)
    momentum = 1.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(x @ v[1:].astype(np.float32) + np.float32(v[0])))) - y
        moved = v - step * np.concatenate([[error.mean()], x.T @ error / n])
        moved[1:] = np.sign(moved[1:]) * np.maximum(np.abs(moved[1:]) - step * penalty, 0)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v = moved + (momentum - 1) / following * (moved - w)
        w, momentum = moved, following
    return float(w[0]), w[1:]


def fit_arrays(
    columns: dict[str, np.ndarray], label: np.ndarray, trees: int = 60, depth: int = 3, least: int = 8, bins: int = 48,
    shrink: float = 0.15, penalty: float = 1e-3, rounds: int = 600, seed: int = 5,
) -> Ensemble:
    """The ensemble for statistics and 0/1 labels; one class or no rows give a constant."""
    n = len(label)
    if not n or label.min() == label.max():
        share = (label.sum() + 1) / (n + 2)
        return Ensemble(float(np.log(share / (1 - share))))
    names = sorted(columns)
    cuts = [np.unique(np.quantile(columns[c], np.linspace(0, 1, bins + 1)[1:-1])) for c in names]
    codes = np.stack([np.searchsorted(b, columns[c], side="right") for b, c in zip(cuts, names, strict=True)], axis=1)
    draws, fitted, rules = np.random.default_rng(seed), np.zeros(n), {}
    for _ in range(trees):
        rows = draws.choice(n, max(2, n // 2), replace=False)
        residual = label - 1 / (1 + np.exp(-fitted))
        paths, value = _tree(codes[rows], cuts, residual[rows], depth, least)
        for path in paths:
            rules.setdefault(Rule(tuple(sorted((names[j], up, b) for j, up, b in path))))
        leaves = [p for p in paths if not any(q[:-1] == p for q in paths)]
        for path in leaves:
            inside = np.logical_and.reduce([(columns[names[j]] >= b) == up for j, up, b in path])
            both = inside[rows]
            fitted[inside] += shrink * 8 * residual[rows][both].mean()
    rules = list(rules)
    ranges = {c: tuple(map(float, np.quantile(columns[c], (0.025, 0.975)))) for c in names}
    ranges = {c: r for c, r in ranges.items() if r[1] > r[0]}
    clipped = np.stack([np.clip(columns[c], *ranges[c]) for c in ranges], axis=1) if ranges else np.empty((n, 0))
    x = np.empty((n, len(rules) + clipped.shape[1]), np.float32)  # the one large array of a fit, scaled in place
    for k, rule in enumerate(rules):
        x[:, k] = rule.holds(columns)
    x[:, len(rules) :] = clipped
    centre = x.mean(axis=0, dtype=float)
    x -= centre.astype(np.float32)
    spread = np.maximum(np.sqrt((x**2).mean(axis=0, dtype=float)), 1e-3)
    x /= spread.astype(np.float32)
    start, weights = _lasso_logistic(x, label.astype(np.float32), penalty, rounds)
    weights = weights / spread
    out = Ensemble(float(start - weights @ centre))
    out.rules = [(float(w), r) for w, r in zip(weights, rules, strict=False) if abs(w) > 1e-6]
    out.linear = {c: (float(w), *ranges[c]) for w, c in zip(weights[len(rules) :], ranges, strict=True) if abs(w) > 1e-6}
    return out


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the identifier as text leaves 2 modulo 4. A null identifier teaches nothing either."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(True))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> Ensemble:
    """Fit on at most `sample_rows` labelled rows outside the held-out ones; only their statistics reach the driver.

    Labels that are null or not 0 or 1 are left out; a doc_id labelled twice counts once, with its smallest label.
    """
    drawn = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_label"))
    drawn = drawn.where(F.col("_label").isin(0, 1) & ~held_out(F.col("_id"))).groupBy("_id").agg(F.min("_label").alias("_label"))
    drawn = drawn.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    text = docs.select(F.col(f"`{id_col}`").alias("_id"), whole_text(text_col).alias("_text"))
    joined = text.join(F.broadcast(drawn), "_id").dropDuplicates(["_id"])
    rows = joined.select("_label", *[c.cast("double").alias(n) for n, c in statistics(F.col("_text")).items()]).toPandas()
    label = rows.pop("_label").to_numpy()
    order = np.lexsort(rows.to_numpy().T) if len(rows) else []
    return fit_arrays({c: rows[c].to_numpy()[order] for c in rows}, label[order])


def score(
    docs: DataFrame, model: Ensemble, id_col: str = "doc_id", text_col: str = "text", accept: float = 0.7
) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 where score >= accept).

    Null texts count as empty and get the score of the empty text; equal texts get equal scores. No rows give no rows.
    Only the identifier and the text are read, the identifier for `held_out` alone.
    """
    text = docs.select(F.col(f"`{id_col}`").alias("doc_id"), whole_text(text_col).alias("_text"))
    known = text.select("doc_id", *[c.cast("double").alias(f"_{n}") for n, c in statistics(F.col("_text")).items()])
    scored = known.select("doc_id", model.column({n: F.col(f"_{n}") for n in statistics(F.lit(""))}).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Ensemble, text_col: str = "text", accept: float = 0.7) -> DataFrame:
    """The rows of docs whose text scores at least `accept`, with all their columns."""
    known = {f"_{n}": c.cast("double") for n, c in statistics(whole_text(text_col)).items()}
    # below a projection with a row number the filter cannot slip, where each rule would compute the statistics anew
    rows = docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row"), *[c.alias(n) for n, c in known.items()])
    scored = rows.select("doc", model.column({n: F.col(f"_{n}") for n in statistics(F.lit(""))}).alias("score"), "row")
    return scored.where((F.col("score") >= accept) & (F.col("row") >= 0)).select("doc.*")
