"""rosterlens: workforce-panel analytics on Spark DataFrames.

Layers: ``sources`` (panel readers), ``functions`` (column expressions),
``operators`` (table operators), ``plans`` (the registered analyses),
``streaming`` (incremental reading of snapshot files).
"""

__version__ = "0.1.0"
