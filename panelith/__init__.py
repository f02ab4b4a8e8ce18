"""Panel forecasting on Spark DataFrames.

The names below are read on first use, so that Python workers that need a part of the package load no more.
"""

from __future__ import annotations

import importlib

_PLACES = {
    "forecast": "panelith.plans.forecast", "panel_forecast": "panelith.plans.forecast", "PanelForecaster": "panelith.plans.forecast", "explode_channels": "panelith.plans.forecast", "forecast_start": "panelith.plans.forecast",
    "FREQ_TO_PERIOD": "panelith.constants", "FREQ_TO_PERIODS": "panelith.constants",
}
__all__ = sorted(_PLACES)


def __getattr__(name: str):
    if name in _PLACES:
        return getattr(importlib.import_module(_PLACES[name]), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
