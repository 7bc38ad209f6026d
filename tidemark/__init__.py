"""Point-in-time analytics on Spark: time-aware joins, rolling windows, cross-sectional
research, cost-aware backtests and document features, expressed as DataFrame plans."""

__version__ = "0.1.0"
