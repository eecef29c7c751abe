"""Quality classifier: a sparse rule ensemble.

Text statistics are column expressions over whole texts. On a bounded sample of labelled rows (max_rows)
the driver grows small randomised trees, takes every path from a root as a conjunctive rule, and fits
lasso logistic weights to the rules; most become zero. The rules that are left are compiled into column
expressions, so scoring is one projection, with no join, no shuffle and no Python on the executors.

Nulls: a null text is an empty one, all of whose shares are 0; it gets a score like any other. A null
label isn't learned from. With no labelled row the score is 0.5; with one class only, its share. Equal rows
each give a row. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ROWS = 6000


def bound(value: Column, use) -> Column:
    """use(value) with value worked out once, wherever the optimiser moves the expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def statistics(text: Column) -> Column:
    """A struct of a text's statistics, each a double."""

    def of(t: Column, words: Column, lines: Column) -> Column:
        chars = F.length(t)
        share = lambda pattern: F.length(F.regexp_replace(t, pattern, "")) / F.greatest(chars, F.lit(1))
        found = {
            "chars": F.log1p(chars.cast("double")),
            "words": F.log1p(F.size(words).cast("double")),
            "word_length": chars / F.size(words),
            "distinct_words": F.size(F.array_distinct(words)) / F.size(words),
            "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
            "symbols": share(r"[^|*%&#$@~^!_=<>{}\[\]\\/+]+"),
            "capitals": share(r"\P{Lu}+"),
            "digits": share(r"\P{Nd}+"),
            "letters": share(r"\P{L}+"),
            "stops": share(r"[^.,;:?]+"),
        }
        return F.struct(*[c.alias(n) for n, c in found.items()])

    t = F.coalesce(text, F.lit(""))
    words = F.split(F.trim(F.regexp_replace(F.lower(t), r"[\x20\x09-\x0D]+", " ")), " ", -1)
    parts = F.struct(t.alias("t"), words.alias("words"), F.split(t, "\n", -1).alias("lines"))
    return bound(parts, lambda p: of(p["t"], p["words"], p["lines"]))


NAMES = ["chars", "words", "word_length", "distinct_words", "distinct_lines", "symbols", "capitals", "digits", "letters", "stops"]

#: A rule is a tuple of (statistic, above?, threshold): all must hold; above means > threshold.
Rule = tuple[tuple[str, bool, float], ...]


def _grow(x: np.ndarray, y: np.ndarray, names: list[str], depth: int, path: Rule, rng: np.random.Generator) -> list[Rule]:
    """The paths of one randomised tree to all its nodes but the root."""
    if depth == 0 or len(y) < 20 or y.min() == y.max():
        return []
    best = (np.inf, -1, 0.0)
    for j in rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False):
        v = np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 33)))
        if len(v) < 2:
            continue
        cuts = (v[1:] + v[:-1]) / 2
        order = np.argsort(x[:, j])
        upto = np.searchsorted(x[order, j], cuts, "right")
        ones = np.concatenate([[0], np.cumsum(y[order])])
        n1, p1 = upto, ones[upto]
        n2, p2 = len(y) - n1, ones[-1] - p1
        fit = (n1 >= 5) & (n2 >= 5)
        gini = np.where(fit, p1 * (n1 - p1) / np.maximum(n1, 1) + p2 * (n2 - p2) / np.maximum(n2, 1), np.inf)
        k = int(gini.argmin())
        if gini[k] < best[0]:
            best = (float(gini[k]), int(j), float(cuts[k]))
    if best[1] < 0:
        return []
    _, j, cut = best
    out: list[Rule] = []
    for above in (False, True):
        own = (x[:, j] > cut) == above
        step = (*path, (names[j], above, cut))
        out += [step, *_grow(x[own], y[own], names, depth - 1, step, rng)]
    return out


def _holds(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, above, cut in rule:
        out &= (x[:, names.index(name)] > cut) == above
    return out


def _lasso(m: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights with an L1 penalty, by accelerated proximal gradient; the intercept isn't penalised."""
    n = len(y)
    a = np.column_stack([m, np.ones(n)])
    lipschitz = 0.25 * np.linalg.norm(a, 2) ** 2 / n + 1e-9
    w = z = np.zeros(a.shape[1])
    momentum = 1.0
    for _ in range(steps):
        slope = a.T @ (1 / (1 + np.exp(-np.clip(a @ z, -30, 30))) - y) / n
        u = z - slope / lipschitz
        fresh = np.sign(u) * np.maximum(np.abs(u) - penalty / lipschitz, 0)
        fresh[-1] = u[-1]
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        z = fresh + (momentum - 1) / after * (fresh - w)
        w, momentum = fresh, after
    return w[:-1], float(w[-1])


class RuleEnsemble:
    """Weighted rules over the statistics."""

    def __init__(self, rules: list[tuple[Rule, float]], intercept: float) -> None:
        self.rules, self.intercept = rules, intercept

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 40, depth: int = 3, penalty: float = 0.002) -> RuleEnsemble:
        if not len(y) or y.min() == y.max():
            p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
            return cls([], float(np.log(p / (1 - p))))
        rng = np.random.default_rng(5)
        rules: dict[bytes, Rule] = {}
        for _ in range(trees):
            own = rng.choice(len(y), max(1, int(0.7 * len(y))), replace=False)
            for rule in _grow(x[own], y[own], names, depth, (), rng):
                rules.setdefault(np.packbits(_holds(rule, x, names)).tobytes(), rule)
        found = list(rules.values())
        m = np.column_stack([_holds(r, x, names) for r in found]).astype(float)
        w, b = _lasso(m, y, penalty)
        return cls([(r, float(v)) for r, v in zip(found, w) if v], b)

    def score(self, stats: Column) -> Column:
        """The probability of label 1, from a struct of statistics."""
        logit = F.lit(self.intercept)
        for rule, weight in self.rules:
            test = F.lit(True)
            for name, above, cut in rule:
                test = test & (stats[name] > F.lit(cut) if above else stats[name] <= F.lit(cut))
            logit = logit + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-logit))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> RuleEnsemble:
    """Learned from the max_rows labelled documents, held-out ones aside, whose doc_id hashes least."""
    known = labels.filter("doc_id is not null and quality is not null").filter(~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").alias("__id"), F.col("quality").alias("__y")).orderBy(F.xxhash64("__id"), "__y").limit(max_rows)
    drawn = docs.select("doc_id", "text").join(F.broadcast(known), docs["doc_id"] == F.col("__id")).select("__id", "__y", statistics(F.col("text")).alias("s"))
    rows = np.array([(r[0], r[1], *r[2]) for r in drawn.limit(2 * max_rows).collect()], float).reshape(-1, 2 + len(NAMES))
    rows = rows[np.lexsort(rows.T[::-1])]
    return RuleEnsemble.fit(rows[:, 2:], (rows[:, 1] > 0).astype(float), NAMES)


def score_of(text: Column, model: RuleEnsemble) -> Column:
    return bound(statistics(text), model.score)


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, max_rows)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), score_of(F.col("text"), model).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """docs without those that score under 0.5."""
    return docs.filter(score_of(F.col("text"), fit(docs, labels, max_rows)) >= 0.5)
