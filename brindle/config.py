"""Cost assumptions and thresholds; overrides are checked (known key, finite, not negative), others are ignored."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Assumptions:
    # Default cost assumptions and ranking thresholds of the domain.
    huf_per_usd: float = 345.0
    huf_per_eur: float = 395.0
    inbound: float = 2500.0
    inspection: float = 0.0
    tax: float = 0.15
    reserve: float = 0.05
    asking_to_sale: float = 0.85
    hu_fee: float = 0.08
    hu_payment: float = 0.0
    hu_packaging: float = 2000.0
    hu_outbound: float = 0.0
    hu_listing: float = 0.0
    us_fee: float = 0.136
    us_fixed_usd: float = 0.40
    us_payment: float = 0.0
    us_fx: float = 0.03
    us_packaging: float = 6000.0
    us_ship_small: float = 22000.0
    us_ship_large: float = 45000.0
    us_duty: float = 0.15
    min_profit: float = 5000.0
    min_confidence: float = 0.35
    auction_penalty: float = 0.5
    damage_penalty: float = 0.5
    flag_discount: float = 15.0

    def override(self, values: dict) -> Assumptions:
        known = {f.name for f in fields(self)}
        good = {k: float(v) for k, v in values.items() if k in known and isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) and v >= 0}
        return replace(self, **good)


DEFAULT = Assumptions()
LARGE_SIZE_CM = 25
#: Value ranges of the data set by market.
RANGES = {"HU": (500, 20_000_000), "US": (5, 60_000)}
