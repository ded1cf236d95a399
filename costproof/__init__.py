"""Portfolio-scale reconciliation of cost documents as Spark DataFrame operators."""

__version__ = "0.1.0"
