"""A dataflow script engine that lowers to Spark DataFrames."""

from .session import Session
from .types import ScriptError

__all__ = ["ScriptError", "Session"]
