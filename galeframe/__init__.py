"""Weather-grid and storm-track analytics on Spark DataFrames.

Grids are long tables with one row per cell, storm tracks are tables with one row
per point.  ``functions`` holds Column -> Column rules, ``operators`` holds
DataFrame -> DataFrame steps, ``sources`` and ``sinks`` read and write the
documents around them, and ``streaming`` keeps tracks up to date.
"""

__version__ = "0.1.0"
