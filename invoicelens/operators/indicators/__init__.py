"""The named indicators, by subject. Importing this package registers them all."""

from invoicelens.operators.indicators import customers, profitability, returns, sales, strategy, zones

__all__ = ["customers", "profitability", "returns", "sales", "strategy", "zones"]
