"""All operators; importing this package fills the registry."""

from . import channels, characteristics, moving_averages, oscillators, patterns, trends, volume

__all__ = ["channels", "characteristics", "moving_averages", "oscillators", "patterns", "trends", "volume"]
