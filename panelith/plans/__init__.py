"""Whole forecasts of a panel."""
