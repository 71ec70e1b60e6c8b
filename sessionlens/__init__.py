"""sessionlens: product-funnel analytics over web events, as PySpark DataFrame operators."""

from sessionlens.model import EventWindow, FunnelSpec

__all__ = ["EventWindow", "FunnelSpec"]
