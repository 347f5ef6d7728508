"""Business thresholds, passed to the jobs so that no job hides a constant."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Rules:
    # customer segments
    churned_after_days: int = 365
    at_risk_after_days: int = 180
    vip_above_spent: int = 5_000
    vip_above_orders: int = 20
    regular_above_orders: int = 1
    # lifetime value tiers
    premium_from: int = 10_000
    high_from: int = 2_500
    medium_from: int = 500
    # product revenue tiers
    top_revenue_from: int = 10_000
    high_revenue_from: int = 5_000
    medium_revenue_from: int = 1_000
    # product units per month
    very_fast_from: int = 50
    fast_from: int = 20
    normal_from: int = 5
    # windows
    backfill_days: int = 7
    trend_months: int = 24
    audit_window_days: int = 90
    audit_retention_days: int = 2555

    @classmethod
    def reference(cls) -> Rules:
        return cls()

    @classmethod
    def testdata(cls) -> Rules:
        """Thresholds that spread the shared test tables over all classes."""
        return cls(
            vip_above_spent=3_000_000,
            premium_from=3_000_000,
            high_from=2_000_000,
            medium_from=1_000_000,
            top_revenue_from=1_800_000,
            high_revenue_from=1_600_000,
            medium_revenue_from=1_350_000,
            very_fast_from=12,
            fast_from=10,
            normal_from=8,
        )

    @classmethod
    def from_mapping(cls, settings: Mapping[str, int]) -> Rules:
        """Override the defaults by field name; an unknown name is an error."""
        known = {f.name for f in fields(cls)}
        unknown = set(settings) - known
        if unknown:
            raise ValueError(f"unknown rule(s): {sorted(unknown)}")
        return replace(cls(), **settings)
