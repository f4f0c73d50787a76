"""Quality classifier: a sparse ensemble of rules.

Statistics of the text are Spark columns. Small trees boosted on a bounded
sample of labelled rows give paths, every path is a conjunctive rule, a lasso
logistic regression weighs the rules, and the rules with a weight are compiled
back into Spark columns that score every row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 20_000


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text, none of which is null; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    chars = F.length(text)
    whole = F.greatest(chars, F.lit(1))
    words = F.split(F.trim(text), r"\s+")
    n = F.greatest(F.size(words), F.lit(1))

    def literal(char: str) -> Column:
        return chars - F.length(F.replace(text, F.lit(char), F.lit("")))

    def of(pattern: str) -> Column:
        return chars - F.length(F.regexp_replace(text, pattern, ""))

    return {
        "chars": chars.cast("double"),
        "words": F.size(words).cast("double"),
        "word_length": chars / n,
        "distinct": F.size(F.array_distinct(words)) / n,
        "upper": of(r"\p{Lu}+") / whole,
        "digits": of(r"[0-9]+") / whole,
        "symbols": of(r"[#$%&*<>=@^_~{}\[\]\\/|+]+") / whole,
        "shouts": literal("!") / n,
        "bars": literal("|") / n,
        "stops": literal(".") / n,
        "commas": literal(",") / n,
        "lines": literal("\n") / n,
    }


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic, above, threshold) that hold together."""

    conditions: tuple[tuple[str, bool, float], ...]

    def over(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), dtype=bool)
        for name, above, at in self.conditions:
            out &= (x[name] > at) if above else (x[name] <= at)
        return out

    def column(self, x: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, above, at in self.conditions:
            out = out & ((x[name] > at) if above else (x[name] <= at))
        return out


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, x: dict[str, Column]) -> Column:
        """Probability of label 1 as a Spark column."""
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            z = z + F.when(rule.column(x), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _tree(x: dict[str, np.ndarray], cuts: dict[str, np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: int) -> list[tuple[tuple, float]]:
    """Paths and leaf values of a tree that fits the gradients ``g``."""

    def grow(rows: np.ndarray, path: tuple, left: int) -> list[tuple[tuple, float]]:
        value = g[rows].sum() / (h[rows].sum() + 1)
        best = None
        if left and len(rows) >= 2 * least:
            for name, at in cuts.items():
                place = np.searchsorted(at, x[name][rows], "left")
                gs = np.cumsum(np.bincount(place, g[rows], len(at) + 1))[:-1]
                hs = np.cumsum(np.bincount(place, h[rows], len(at) + 1))[:-1]
                ns = np.cumsum(np.bincount(place, minlength=len(at) + 1))[:-1]
                ok = (ns >= least) & (len(rows) - ns >= least)
                if ok.any():
                    gain = np.where(ok, gs**2 / (hs + 1) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + 1), -1)
                    i = int(gain.argmax())
                    if best is None or gain[i] > best[0] + 1e-12:
                        best = gain[i], name, float(at[i])
        if best is None or best[0] <= g[rows].sum() ** 2 / (h[rows].sum() + 1) + 1e-9:
            return [(path, value)]
        _, name, at = best
        low = x[name][rows] <= at
        return grow(rows[low], (*path, (name, False, at)), left - 1) + grow(rows[~low], (*path, (name, True, at)), left - 1)

    return grow(np.arange(len(g)), (), depth)


def tree_rules(x: dict[str, np.ndarray], y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, least: int = 10) -> list[Rule]:
    """The paths, whole and cut short, of boosted trees, without repeats."""
    cuts = {k: np.unique(np.quantile(v, np.linspace(0.01, 0.99, 64))) for k, v in x.items()}
    z = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    found: dict[frozenset, Rule] = {}
    for _ in range(trees):
        p = _sigmoid(z)
        for path, value in _tree(x, cuts, y - p, p * (1 - p), depth, least):
            z += rate * value * Rule(path).over(x)
            for n in range(1, len(path) + 1):
                found.setdefault(frozenset(path[:n]), Rule(path[:n]))
    return list(found.values())


def lasso(a: np.ndarray, y: np.ndarray, strength: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal steps."""
    n, m = a.shape
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    v, c, t = w.copy(), b, 1.0
    top = np.linalg.norm(a[:: max(1, n // 4000)], 2) ** 2 / len(a[:: max(1, n // 4000)])
    step = 1 / (0.25 * (top * 1.2 + 1))
    for _ in range(rounds):
        r = _sigmoid(a @ v + c) - y
        new = v - step * (a.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * strength, 0)
        new_b = c - step * r.mean()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return b, w


def fit_rules(x: dict[str, np.ndarray], y: np.ndarray, strength: float = 2e-3) -> RuleModel:
    """Sparse rule model of statistics ``x`` and labels ``y`` (0 or 1); a
    constant where there are no rows or one label only."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return RuleModel(float(np.log(p / (1 - p))), ())
    rules = tree_rules(x, y)
    if not rules:
        return RuleModel(float(np.log(y.mean() / (1 - y.mean()))), ())
    a = np.stack([r.over(x) for r in rules], axis=1).astype(np.float64)
    b, w = lasso(a, y, strength)
    return RuleModel(float(b), tuple((r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-4))


def fit_quality(documents: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 3, held: int = 1, sample: int = SAMPLE) -> RuleModel:
    """Model of at most ``sample`` labelled rows, those with the smallest hash
    of their key, out of the rows whose fold isn't ``held``."""
    known = labels.select(labels[key].alias("doc_id"), labels[label].cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held))
    # Both sides of the join are bounded by the sample: it may be broadcast.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    rows = documents.select(documents[key].alias("doc_id"), documents[text].alias("text")).join(F.broadcast(chosen), "doc_id")
    x = statistics(F.col("text"))
    table = rows.select("doc_id", "y", *(c.alias(k) for k, c in x.items())).orderBy(F.xxhash64("doc_id"), "doc_id", "y", "chars").limit(sample).toPandas()
    return fit_rules({k: table[k].to_numpy(dtype=np.float64) for k in x}, table["y"].to_numpy(dtype=np.float64))


def fold(column: str, folds: int) -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % folds


def score_quality(documents: DataFrame, model: RuleModel, *, key: str = "doc_id", text: str = "text", folds: int = 3, held: int = 1, carry: list[str] | None = None) -> DataFrame:
    """One row a row: doc_id, text, held_out, score (0 to 1), predicted, and
    the columns named in ``carry``.

    Null and empty texts have the statistics of the empty text and are scored
    like any other; a long text is measured whole; a score of exactly a half
    counts as 1; a null key is in the fold of the empty text; repeated rows
    score alike; an empty table gives no rows; extra columns are ignored.
    """
    others = [c for c in carry or [] if c not in (key, text)]
    more = F.struct(*(documents[c] for c in others)) if others else F.lit(None).cast("struct<none:int>")
    rows = documents.select(documents[key].alias("doc_id"), documents[text].alias("text"), more.alias("more"))
    x = statistics(F.col("text"))
    used = sorted({c[0] for rule, _ in model.rules for c in rule.conditions})
    measured = rows.select("doc_id", "text", "more", *(x[k].alias(k) for k in used))
    # inline() keeps the optimizer from writing the statistics into every rule.
    measured = measured.select("doc_id", "text", "more", F.inline(F.array(F.struct(F.lit(0).alias("_"), *(F.col(k).alias(f"_{k}") for k in used)))))
    score = model.score({k: F.col(f"_{k}") for k in used})
    scored = measured.select("doc_id", "text", "more", (fold("doc_id", folds) == held).alias("held_out"), score.alias("score"))
    return scored.select("doc_id", "text", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *(F.col(f"more.`{c}`") for c in others))
