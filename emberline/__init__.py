"""Sensor-telemetry analytics for device fleets, as Spark DataFrame jobs."""

from emberline.config import RuntimeConfig

__all__ = ["RuntimeConfig"]
