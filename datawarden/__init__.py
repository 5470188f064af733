"""Dataset profiling, classification, scoring and cataloguing on Spark DataFrames."""

from datawarden.config import Settings, SettingsError

__all__ = ["Settings", "SettingsError"]
