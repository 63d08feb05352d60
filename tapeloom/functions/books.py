"""Order-book summaries, computed inside one row from its two level arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeloom.functions.lenient import safe_ratio, to_double

BOOK_COLUMNS = (
    "ob_best_bid", "ob_best_ask", "ob_mid", "ob_spread",
    "ob_bid_depth_topn", "ob_ask_depth_topn", "ob_imbalance_topn",
)


def book_side(levels: Column, top_n: int) -> Column:
    """Struct (price, depth) over the first ``top_n`` levels in payload order.

    The price is that of the first readable level. Levels with an unreadable price or size are
    skipped; no levels at all means no depth.
    """
    read = F.transform(
        F.slice(levels, 1, top_n),
        lambda lvl: F.struct(to_double(lvl["price"]).alias("p"), to_double(lvl["size"]).alias("s")),
    )
    good = F.filter(read, lambda lvl: lvl["p"].isNotNull() & lvl["s"].isNotNull())
    nothing = F.struct(F.lit(None).cast("double").alias("price"), F.lit(0.0).alias("depth"))
    total = F.aggregate(
        good,
        nothing,
        lambda acc, lvl: F.struct(
            F.coalesce(acc["price"], lvl["p"]).alias("price"), (acc["depth"] + lvl["s"]).alias("depth")
        ),
    )
    return F.when(F.size(levels) > 0, total)


def book_summary(bid_side: Column, ask_side: Column) -> dict[str, Column]:
    """The summary columns from two sides made by :func:`book_side`."""
    bid, bid_depth = bid_side["price"], bid_side["depth"]
    ask, ask_depth = ask_side["price"], ask_side["depth"]
    total = bid_depth + ask_depth
    return {
        "ob_best_bid": bid,
        "ob_best_ask": ask,
        "ob_mid": (bid + ask) / 2,
        "ob_spread": ask - bid,
        "ob_bid_depth_topn": F.when(total > 0, bid_depth),
        "ob_ask_depth_topn": F.when(total > 0, ask_depth),
        "ob_imbalance_topn": F.when(total > 0, F.try_divide(bid_depth - ask_depth, total)),
    }


def book_features(mid: Column, spread: Column, imbalance: Column, bid_depth: Column, ask_depth: Column) -> dict[str, Column]:
    both = (bid_depth > 0) & (ask_depth > 0)
    return {
        "feat_ob_spread": spread,
        "feat_ob_spread_over_mid": safe_ratio(spread, mid, 1e-12),
        "feat_ob_imbalance_topn": imbalance,
        "feat_ob_mid": mid,
        "feat_ob_log_bid_ask_depth_ratio": F.when(both, F.ln(F.try_divide(bid_depth, ask_depth))),
    }
