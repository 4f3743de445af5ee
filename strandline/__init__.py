"""strandline: time-series profiling, quality control and reduction on Spark DataFrames."""

from strandline.plans.layout import Layout
from strandline.plans.ordering import Ordered, order_rows

__all__ = ["Layout", "Ordered", "order_rows"]
