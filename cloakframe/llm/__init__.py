"""Operations of a training-data pipeline; nothing else in the library imports this subpackage."""

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
