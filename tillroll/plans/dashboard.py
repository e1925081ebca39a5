"""The frames a dashboard reads, all lazy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tillroll.sources.tables import Layers


@dataclass
class Dashboard:
    products: DataFrame
    markets: DataFrame
    monthly: DataFrame
    bronze: DataFrame

    @property
    def is_empty(self) -> bool:
        return self.products.isEmpty() and self.monthly.isEmpty()


def load_dashboard(layers: Layers) -> Dashboard:
    """Silver with its derived columns, and Bronze with exact prices."""
    return Dashboard(
        products=layers.scan_product_stats(),
        markets=layers.scan_market_stats(),
        monthly=layers.scan_monthly_spending(),
        bronze=layers.scan_bronze_exact(),
    )
