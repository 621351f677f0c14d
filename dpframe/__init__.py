"""dpframe: privacy-preserving tabular classification analytics on Spark.

Every operator takes and returns DataFrames. Fitting steps (encoders,
scalers, sample boundaries, model weights) collect only small, bounded
statistics to the driver, exactly like Spark ML estimators; the row-level
work always stays in Spark tasks.
"""

from dpframe.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
