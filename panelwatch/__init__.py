"""Find unusual rows in tables that follow many entities over time, on Spark."""

import sys

from pyspark import cloudpickle

from panelwatch.config import EventThresholds, PanelSpec, RuleThresholds
from panelwatch.operators.detector import Detector, Model, refit

# Functions that run in Python workers travel with their job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Detector", "EventThresholds", "Model", "PanelSpec", "RuleThresholds", "refit"]
