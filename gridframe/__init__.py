"""gridframe: gridded, time-stamped records to analysis-ready matrices on Spark.

Every operator is a function DataFrame -> DataFrame built from Spark SQL
expressions; Python runs only inside Arrow-batched tasks (archive and grid
decoding, the blocked tile transpose).

Naming: ``A^T`` is records x cells (one row per record), ``A`` is
cells x records (one row per cell).
"""

__version__ = "0.1.0"
