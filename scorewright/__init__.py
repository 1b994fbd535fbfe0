"""Spark library for corpus preparation, sequence assembly, trajectory and benchmark evaluation."""

from scorewright.session import configure, local_session
from scorewright.registry import register_pandas_scorer, register_report, register_scorer

__all__ = ["configure", "local_session", "register_scorer", "register_pandas_scorer", "register_report"]
