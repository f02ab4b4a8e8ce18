"""Panels and forecasts over streams."""
