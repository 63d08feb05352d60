"""Quality rules as a short-circuit cascade of column expressions.

The measures of a text (words, symbols, repeated lines, repeated word triples) are native array
expressions of one row; nothing is exploded or shuffled. A text fails the base if it is short or
repeats itself. The further rules run as a cascade: on a sample of rows each rule's rejections are
counted and its cost per row is taken, and the rules are ordered by rejections per cost. The cost is
the time of a job that evaluates the rule ``repeats`` times on every row of the sample, less that of
the same job without the rule (starting jobs and reading rows is no rule's cost); of ``rounds`` such
measurements the least counts. A row that one rule rejects skips the rest. The order changes the
work, never the verdict.

Defined results: a missing or empty text has no words and fails the base; ties in the order of rules
fall to their declared order; repeated rows are judged each; an empty table gives no rows; other
columns are ignored, whatever their names; a text of any length is measured whole, within one row.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.rows import staged, text_of
from tapeloom.operators.once import with_evaluated

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
NOT_BLANK = "[^\\x20\\x09-\\x0D]"


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """Words inside triples of words that the text holds twice or more."""
    last = F.size(words) - 3
    triple = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(
        triple, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )

    def covered(of: Column) -> Column:
        pairs = F.sort_array(F.transform(of, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeats(ordered: Column) -> Column:
            same = F.filter(
                ordered,
                lambda x, i: F.coalesce(x.h == F.get(ordered, i - 1).h, F.lit(False))
                | F.coalesce(x.h == F.get(ordered, i + 1).h, F.lit(False)),
            )
            return F.sort_array(F.transform(same, lambda x: x.i))

        return F.aggregate(
            _bound(pairs, repeats),
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
            lambda done, at: F.struct(
                (done.n + F.least(F.lit(3), at - done.last)).alias("n"), at.alias("last")
            ),
            lambda done: done.n,
        )

    return _bound(
        hashes,
        lambda of: F.when(F.size(F.array_distinct(of)) == F.size(of), F.lit(0).cast("long")).otherwise(
            covered(of)
        ),
    )


def measures(text: Column) -> dict[str, Column]:
    """Counts of one text; each is a whole number."""
    words = F.regexp_extract_all(text, F.lit(f"{NOT_BLANK}+"), F.lit(0))
    counted = _bound(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("words"), _repeated(w).cast("long").alias("repeat")
        ),
    )
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(NOT_BLANK))
    doubles = _bound(lines, lambda of: F.size(of) - F.size(F.array_distinct(of)))
    return {
        "counted": counted,
        "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": doubles.cast("long"),
    }


def _letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "\\P{L}+", ""))


def default_rules() -> dict[str, Callable[[], Column]]:
    """Rules by name; each is true where it rejects. The last three read the text itself."""
    col = F.col
    return {
        "word_length": lambda: (col("word_chars") < 2 * col("n_words"))
        | (col("word_chars") > 15 * col("n_words")),
        "symbols": lambda: 10 * col("n_symbols") > col("n_words"),
        "dup_lines": lambda: 3 * col("n_dup_lines")
        > F.size(F.split(col("text"), "\n", -1)),
        "letters": lambda: 10 * _letters(col("text")) < 6 * col("word_chars"),
        "capitals": lambda: 2 * F.length(F.regexp_replace(col("text"), "\\P{Lu}+", ""))
        > _letters(col("text")),
    }


@dataclass(frozen=True)
class Cascade:
    """``sample_rows``: rows on which cost and rejection of each rule are estimated, the cost by
    ``repeats`` evaluations on each row, the best of ``rounds``."""

    min_words: int = 50
    sample_rows: int = 2000
    repeats: int = 32
    rounds: int = 2
    seed: int = 11
    rules: dict[str, Callable[[], Column]] = field(default_factory=default_rules)


def measured(docs: DataFrame, cfg: Cascade, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, the counts and ``base_failed``."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    rows = with_evaluated(rows, measures(F.col("text")))
    rows = rows.withColumns(
        {"n_words": F.col("counted.words"), "n_repeat_words": F.col("counted.repeat")}
    ).drop("counted")
    short = F.col("n_words") < cfg.min_words
    return rows.withColumn(
        "base_failed", short | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )


def _seconds(rows: DataFrame, *counts: Column) -> float:
    began = time.perf_counter()
    rows.agg(*[F.count(c) for c in rows.columns], *counts).first()
    return time.perf_counter() - began


def rule_costs(sample: DataFrame, cfg: Cascade) -> dict[str, float]:
    """Seconds that each rule adds to a job over ``repeats`` copies of every row."""
    rows = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(cfg.repeats))).alias("_copy"))
    least = dict.fromkeys([None, *cfg.rules], math.inf)
    _seconds(rows)  # the first read of the table is no rule's cost
    for _ in range(cfg.rounds):
        for name in least:
            taken = _seconds(rows, *[F.count_if(cfg.rules[n]()) for n in [name] if n is not None])
            least[name] = min(least[name], taken)
    plain = least.pop(None)
    # Differences below a twentieth of the plain job cannot be told apart.
    return {name: max(taken - plain, plain / 20) for name, taken in least.items()}


def ordered_rules(docs: DataFrame, cfg: Cascade, id_col: str, text_col: str) -> list[str]:
    """Names of the rules, most rejections per cost on the sample first."""
    total = docs.count()
    if not total:
        return list(cfg.rules)
    share = min(1.0, cfg.sample_rows / total)
    sample = measured(docs.sample(fraction=share, seed=cfg.seed), cfg, id_col, text_col)
    sample = staged(sample.filter(~F.col("base_failed")), "rule-sample")
    rejected = sample.agg(*[F.count_if(rule()).alias(name) for name, rule in cfg.rules.items()]).first()
    costs = rule_costs(sample, cfg)
    return sorted(cfg.rules, key=lambda name: -rejected[name] / costs[name])


def judge(
    docs: DataFrame, cfg: Cascade | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, the counts, base_failed and kept."""
    cfg = cfg or Cascade()
    rows = measured(docs, cfg, id_col, text_col)
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for name in ordered_rules(docs, cfg, id_col, text_col):
        verdict = verdict.when(cfg.rules[name](), F.lit(name))
    rows = rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", verdict.alias("verdict"),
    )
    return rows.select(*rows.columns[:-1], F.col("verdict").isNull().alias("kept"))
