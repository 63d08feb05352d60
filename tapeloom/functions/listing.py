"""Predicates and labels on a market listing row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeloom.functions.lenient import is_nan_text, strip, strip_unicode, to_double

# Market types that are no plain match-up.
LINE_MARKET_TYPES = ("spreads", "spread", "totals", "total")
# The word between two sides, and the marks of props, spreads and totals.
VERSUS = r"(?iU)\s+vs\.?\s+"
PROP_PREFIX, SPREAD_PREFIX, TOTAL_TAIL, TOTAL_MARK = "will ", "spread:", ": o/u", "o/u"


def passes_prefilter(volume: Column, liquidity: Column, min_volume: float, min_liquidity: float) -> Column:
    """Both at least as large as wanted; missing and unreadable count as 0, "nan" never passes."""

    def enough(raw: Column, least: float) -> Column:
        number = F.coalesce(to_double(raw), F.lit(0.0)) >= F.lit(float(least))
        return number & ~F.coalesce(is_nan_text(raw), F.lit(False))

    return enough(volume, min_volume) & enough(liquidity, min_liquidity)


def is_plain_market_type(market_type: Column) -> Column:
    return ~F.lower(strip(F.coalesce(market_type, F.lit("")))).isin(*LINE_MARKET_TYPES)


def is_head_to_head(question: Column) -> Column:
    """True for "A vs. B" titles that are not props, spreads or totals; NULL text is False."""
    title = strip_unicode(F.coalesce(question, F.lit("")))
    low = F.lower(title)
    sides = F.transform(F.split(title, VERSUS, 2), strip_unicode)
    wagers = (
        low.startswith(PROP_PREFIX)
        | low.startswith(SPREAD_PREFIX)
        | low.contains(TOTAL_TAIL)
        | (low.contains(TOTAL_MARK) & low.contains(" vs"))
    )
    named = (F.size(sides) == 2) & F.forall(
        sides, lambda side: (F.length(side) >= 2) & ~F.lower(side).startswith(SPREAD_PREFIX)
    )
    return ~wagers & named


def is_yes_no(outcomes: Column) -> Column:
    names = F.array_sort(F.transform(outcomes, F.lower))
    return F.coalesce(names == F.array(F.lit("no"), F.lit("yes")), F.lit(False))


def is_moneyline(outcomes: Column) -> Column:
    """Two named outcomes other than the generic yes/no pair."""
    named = F.forall(outcomes, lambda name: F.coalesce(strip(name) != "", F.lit(False)))
    return F.coalesce((F.size(outcomes) == 2) & ~is_yes_no(outcomes) & named, F.lit(False))


def primary_index(outcomes: Column) -> Column:
    """Position of "yes" in a yes/no pair, else the first outcome."""
    names = F.transform(outcomes, lambda name: F.lower(strip(name)))
    spot = F.array_position(names, "yes") - 1
    return F.when(is_yes_no(outcomes), spot).otherwise(F.lit(0)).cast("int")


def primary_label(outcomes: Column) -> Column:
    return F.coalesce(strip(F.get(outcomes, primary_index(outcomes))), F.lit(""))


def resolved_primary(outcomes: Column, prices: Column) -> Column:
    """1 if the primary outcome won, 0 if it lost, NULL if that cannot be told."""
    final = to_double(F.get(prices, primary_index(outcomes)))
    return F.when(
        F.size(outcomes) == F.size(prices),
        F.when(final > 0.5, F.lit(1)).when(final < 0.5, F.lit(0)),
    )
