"""panelcast — short-term forecasting on panels of time-stamped readings, on Spark.

Every data step is a ``DataFrame -> DataFrame`` function (usable with
``df.transform``) built from Spark SQL expressions, windows and aggregates,
so Catalyst plans it and Tungsten runs it. "Fit" steps (medians, IQR bounds,
split boundaries, scalers, models) run one distributed aggregate or MLlib
job and return a small object that is then applied lazily.
"""

from panelcast.panel import PanelSpec

__all__ = ["PanelSpec"]
__version__ = "0.1.0"
