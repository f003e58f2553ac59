"""scanloom: curation of large imaging-header collections with Spark DataFrames."""

from scanloom.params import PilotParams, ReleasePolicy, ResourceMinimums, SelectionParams, WorkParams

__all__ = [
    "PilotParams",
    "ReleasePolicy",
    "ResourceMinimums",
    "SelectionParams",
    "WorkParams",
]
