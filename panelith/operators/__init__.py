"""Stages of the method as functions from DataFrame to DataFrame. Histories have series_id, i (0-based place) and y."""
