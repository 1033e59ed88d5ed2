"""Delivery tracking on Spark: which machines of which stores got a message, and what went wrong."""

from tillwatch.config import TrackingConfig

__all__ = ["TrackingConfig"]
