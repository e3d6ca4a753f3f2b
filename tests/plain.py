"""Plain loops that the tests hold the library against."""

import numpy as np

from pitwright.functions.exprs import SALES_TAX
from pitwright.plans.portfolio import CAP, LEAST_CAP, TAKEN


def weights(signal: np.ndarray, adv: np.ndarray, account: float, cap: float = CAP) -> np.ndarray:
    """Shares by distance above the median, capped by size and liquidity; what the caps leave is dealt again, the rest is cash."""
    if not len(signal):
        return np.zeros(0)
    above = signal - np.median(signal)
    spread = np.abs(above).mean()
    raw = (np.maximum(above, 0) + 1e-9) ** min(2.0, 0.5 + 8 * spread) if spread >= 1e-6 else np.ones(len(signal))
    adv = np.nan_to_num(adv)
    limit = np.minimum(cap, np.where(adv > 0, np.maximum(TAKEN * adv / account, LEAST_CAP), cap))
    w, free = np.zeros(len(signal)), np.ones(len(signal), dtype=bool)
    while free.any():
        left = 1 - w[~free].sum()
        if left <= 1e-12:
            break
        share = left * raw * free / raw[free].sum()
        over = free & (share > limit)
        w = np.where(free, np.minimum(share, limit), w)
        if not over.any():
            break
        free &= ~over
    return w


def tax_on(day) -> float:
    return [rate for start, rate in SALES_TAX if str(day)[:10] >= start or start == SALES_TAX[0][0]][-1]
