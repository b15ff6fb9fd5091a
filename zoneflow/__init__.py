"""zoneflow: origin-destination trip analytics on PySpark DataFrames."""

from zoneflow.operators.hierarchy import ZoneModel
from zoneflow.operators.rollup import flow_rollup
from zoneflow.params import FlowQuery
from zoneflow.plans.modes import flow_set

__all__ = ["FlowQuery", "ZoneModel", "flow_rollup", "flow_set"]
