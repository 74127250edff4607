"""batchlens: batch-manufacturing analytics as Spark plans.

Every public operator takes and returns ``pyspark.sql.DataFrame`` objects and
builds a lazy plan; nothing is collected to the driver except one-row
statistics that decide between two plan shapes.
"""

__version__ = "0.1.0"
