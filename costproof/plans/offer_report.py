"""Cost estimation: cleaned offers, their checks and the cost table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from costproof.operators import checks, cleansing, offers as offer_ops


@dataclass
class OfferReport:
    offers: DataFrame
    positions: DataFrame
    checks: DataFrame
    table: DataFrame
    labels: DataFrame


def offer_report(offers: DataFrame, positions: DataFrame) -> OfferReport:
    offers = offer_ops.effective_special_price(cleansing.normalize_discounts(offers))
    positions = cleansing.drop_duplicate_discounts(cleansing.unflag_inclusive(positions), offers)
    return OfferReport(
        offers, positions, checks.offer_cross_sum(offers, positions), offer_ops.cost_table(offers, positions),
        offer_ops.offer_report_labels(offers, positions)[0])
