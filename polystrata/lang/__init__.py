"""The query language: text to statements (parser), expressions and reads to DataFrames (planner), statements over stored tables (session)."""

from .errors import Refused
from .session import Session

__all__ = ["Refused", "Session"]
