"""Strategy parameters."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Strategy:
    """One configuration of the signal model.

    The defaults are fixed values: the active configuration the results must match.
    """

    group_weights: dict = field(default_factory=lambda: {
        "quality": 0.40, "growth": 0.25, "value": 0.20, "safety": 0.15})
    minimum_fa_coverage: float = 0.50
    buy_fa_score: float = 65.0
    minimum_trading_value: float = 2e9
    minimum_volume_ratio: float = 0.8
    fa_weight: float = 0.20
    component_weights: dict = field(default_factory=lambda: {
        "momentum": 30.0, "relative_strength": 25.0, "trend": 25.0, "breakout": 15.0, "volume": 5.0})
    entry_score: float = 60.0
    exit_score: float = 35.0
    trend_ma: int = 200
    exit_ma: int = 200
    trailing_stop: float = 0.15
    regime_ma: int = 50
    exit_on_market_regime: bool = False
    max_positions: int = 30
    minimum_holding_days: int = 10
    cooldown_days: int = 5
    reporting_lag_days: int = 90
    min_buy_conditions: int = 5

    def with_(self, **changes) -> "Strategy":
        return replace(self, **changes)

    @property
    def normal_weights(self) -> dict:
        """Component weights scaled to 100; negative ones count as zero."""
        clipped = {k: max(0.0, v) for k, v in self.component_weights.items()}
        total = sum(clipped.values()) or 1.0
        return {k: 100.0 * v / total for k, v in clipped.items()}


ACTIVE = Strategy()

# The driver's tables trade about 6e4 a session, so the liquidity floor is scaled to them,
# and few tickers qualify on one day, so the number of slots is too.
ON_FIXTURES = ACTIVE.with_(minimum_trading_value=5e4, max_positions=3)
