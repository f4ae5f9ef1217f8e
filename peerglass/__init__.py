"""Peer benchmarking and policy imitation over entity-day panels, on Spark.

Layout
------
``params``     plain parameter objects with the published defaults
``functions``  column expressions (row-wise, no shuffle)
``sources``    readers, sinks and mappings onto the table contract
``operators``  DataFrame -> DataFrame building blocks, keyed by ``window_id``
``plans``      compositions: study, assessment, scans, acceptance, weekly, power
"""

from peerglass.params import (
    Gates,
    MarginModel,
    PolicyRules,
    Selection,
    SizeRule,
    SpreadBins,
)

__all__ = ["Gates", "MarginModel", "PolicyRules", "Selection", "SizeRule", "SpreadBins"]
