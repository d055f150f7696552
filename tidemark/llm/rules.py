"""Quality rules: a decision list learned by sequential covering.

Rules reject documents. Each is a conjunction of thresholds on statistics of the text. A rule is grown on
two thirds of the labelled rows, one condition at a time by information gain; then conditions are pruned
from its end while that helps on the other third; rows that it covers are taken away and the next rule is
grown. The list becomes one ordered CASE expression, which Spark evaluates without Python.

It is fitted on a bounded sample of labelled rows (`sample_rows`, chosen by hashes of the ids); statistics and
verdicts cover every row. Without usable labels the list is empty and only the base rules reject.

Null and empty texts have no words, so the base rule rejects them. Repeated rows get a verdict each; other
columns are ignored; several labels of a document count each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import document_stats
from .text import bounded_sample, held_out

#: Labelled rows that the list is fitted on.
SAMPLE_ROWS = 20_000
#: A rule must be right in this share of the rows it covers, in growing and in pruning rows, or learning ends.
LEAST_PRECISION = 0.9
LEAST_COVER = 4
MOST_RULES, MOST_CONDITIONS, CUTS = 12, 3, 64

#: The statistics that conditions test, as Spark SQL over the counts.
MEASURES = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(n_upper + n_lower, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "bang_share": "n_bangs / greatest(n_words, 1)",
    "end_share": "n_ends / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "words": "double(n_words)",
    "words_a_line": "n_words / greatest(n_lines, 1)",
}


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    cut: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.measure] > self.cut if self.above else x[self.measure] <= self.cut

    def sql(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.cut!r}D"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < MOST_CONDITIONS and inside.any() and bad[inside].mean() < 1:
        p0, n0 = bad[inside].sum(), inside.sum()
        best, gain, picked = None, 0.0, inside
        for m, v in x.items():
            for cut in np.unique(np.quantile(v[inside], np.linspace(0, 1, CUTS + 1)[1:-1])):
                for above in (True, False):
                    c = Condition(m, above, float(cut))
                    now = inside & c.holds(x)
                    p, n = bad[now].sum(), now.sum()
                    if p < LEAST_COVER:
                        continue
                    g = p * (np.log2(p / n) - np.log2(p0 / n0))
                    if g > gain + 1e-9:
                        best, gain, picked = c, g, now
        if best is None:
            break
        # half-way between the neighbouring values, so that a rule doesn't hug the rows it was grown on
        v = x[best.measure][inside]
        below, above = v[v <= best.cut], v[v > best.cut]
        rule.append(Condition(best.measure, best.above, float((below.max() + above.min()) / 2)))
        inside = picked
    return tuple(rule)


def worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    hit = covers(rule, x, len(bad))
    p = bad[hit].sum()
    return (2 * p - hit.sum()) / hit.sum() if hit.any() else -1.0


def precision(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    hit = covers(rule, x, len(bad))
    return (bad[hit].sum() + 0.5) / (hit.sum() + 0.5 / LEAST_PRECISION) if hit.any() else 0.0


def learn(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """The ordered rules; x holds the measures of labelled rows, bad whether a row's label is 0."""
    rules: list[Rule] = []
    part = np.arange(len(bad)) % 3
    left = np.ones(len(bad), dtype=bool)
    while len(rules) < MOST_RULES:
        g, p = left & (part != 2), left & (part == 2)
        xg, xp = {m: v[g] for m, v in x.items()}, {m: v[p] for m, v in x.items()}
        if bad[g].sum() < LEAST_COVER:
            break
        rule = grow(xg, bad[g])
        while len(rule) > 1 and worth(rule[:-1], xp, bad[p]) >= worth(rule, xp, bad[p]):
            rule = rule[:-1]
        if not rule or precision(rule, xg, bad[g]) < LEAST_PRECISION or precision(rule, xp, bad[p]) < LEAST_PRECISION:
            break
        rules.append(rule)
        left &= ~covers(rule, x, len(bad))
    return rules


def as_sql(rules: list[Rule]) -> str:
    """One CASE expression: the number of the first rule that holds (from 1), else 0."""
    if not rules:
        return "0"
    return "CASE " + " ".join(f"WHEN {' AND '.join(c.sql() for c in r)} THEN {i}" for i, r in enumerate(rules, 1)) + " ELSE 0 END"


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def measured(stats: DataFrame) -> DataFrame:
    return stats.select("*", *(F.expr(e).alias(m) for m, e in MEASURES.items()))


def fit(stats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """stats: rows of document_stats(); labels: (doc_id, quality). Held-out ids and base failures teach nothing."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 3, 1))
    usable = measured(stats.filter(~base_failed())).join(known, "doc_id").select("doc_id", "label", *MEASURES)
    rows = bounded_sample(usable, "doc_id", sample_rows).toPandas().sort_values(["doc_id", "label"]).sample(frac=1, random_state=0)
    return learn({m: rows[m].to_numpy() for m in MEASURES}, rows["label"].to_numpy() == 0)


def judge(docs: DataFrame, labels: DataFrame, scratch) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and rule (which one rejected, 0: none) of every row."""
    stats = scratch.write(document_stats(docs), "stats")
    rules = fit(stats, labels)
    out = measured(stats).withColumn("base_failed", base_failed()).withColumn("rule", F.expr(as_sql(rules)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")
