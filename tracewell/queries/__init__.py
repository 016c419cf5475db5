"""The queries of the engine, each with the SQL that gives the same rows where SQL can."""

from tracewell.queries import addressing, catalogue, checking, fusing, segmenting, structuring
from tracewell.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "addressing", "catalogue", "checking", "fusing", "segmenting", "structuring"]
