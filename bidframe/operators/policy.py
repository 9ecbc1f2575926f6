"""Policy limits and model coefficients; fixed values unless a caller passes others."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Policy:
    fx_buffer_pct: float = 1.5
    in_stock_lead_days: int = 3
    price_grid_points: int = 90
    default_price_weight_pct: float = 50.0
    max_bundle_cost_share_pct: float = 6.0
    min_offer_reliability: float = 0.6
    match_band_pct: float = 2.0
    min_target_win_probability: float = 0.2
    mse_band_pct: float = 15.0
    mse_share_pct: float = 25.0
    l1_undercut_pct: float = 0.5
    rival_technical_score: float = 75.0
    bundle_kinds: tuple[str, ...] = ("warranty", "service", "support")
    observation_max_age_days: int = 180
    source_reliability: dict[str, float] = field(default_factory=lambda: {"quotes": 0.9, "awards": 0.88, "web": 0.75})
    default_source_reliability: float = 0.8


SEGMENTS = ("enterprise", "smb", "public", "education", "healthcare")
WARRANTY_CLIP, LEAD_CLIP = 24, 21


@dataclass(frozen=True)
class WinModel:
    """Logistic coefficients in original units, in the order of ``ledger.bid_features``."""

    intercept: float = -0.2
    gap: float = -6.0
    gap_by_segment: tuple[float, ...] = (-1.0, -2.0, -3.0, -2.5, -1.5)
    warranty: float = 0.35
    lead: float = -0.2
    bundle: float = 0.56
    repeat: float = 0.4
    segment: tuple[float, ...] = (0.1, -0.1, 0.05, 0.0)
