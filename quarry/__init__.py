"""quarry — Spark-native table-corpus search and QA-trace evaluation.

Every operator is a pure ``DataFrame -> DataFrame`` function that takes
column names, so it composes into one lazy Catalyst plan.  See
``quarry.registry`` for the catalogue and ``__spark_entry__.py`` for the
registered queries.
"""

from quarry.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
