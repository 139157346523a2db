"""twinscan: a PySpark-native engine for near-duplicate structure and training-data preparation."""

__version__ = "0.1.0"

from twinscan.engine import Analysis, analyze  # noqa: E402
from twinscan.options import Options  # noqa: E402

__all__ = ["Analysis", "Options", "analyze"]
