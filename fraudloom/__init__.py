"""Click-fraud analytics as PySpark jobs."""

from fraudloom.config import EngineConfig

__all__ = ["EngineConfig"]
