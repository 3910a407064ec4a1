"""Curation, validation and description of annotated recordings on Spark.

Every public operator takes and returns a ``DataFrame`` (or a ``Column``) and
stays lazy; nothing is collected to the driver along the way.
"""

__version__ = "0.1.0"
