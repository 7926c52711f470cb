"""Feature stages of the trainers that Spark ML lacks: ``1 + ln tf`` and the
smooth idf with one added, ``ln((1 + N) / (1 + df)) + 1``, so that a term
found in every document keeps a weight."""

from __future__ import annotations

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Transformer
from pyspark.ml.feature import IDF, ElementwiseProduct
from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _log_tf(v):
    """Counts to 1 + ln count; absent terms stay absent."""
    s = v if isinstance(v, SparseVector) else SparseVector(len(v), dict(enumerate(v.toArray())))
    kept = s.values > 0
    return SparseVector(s.size, s.indices[kept], 1.0 + np.log(s.values[kept]))


class SublinearTf(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Sublinear term frequencies of a vector of counts."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), F.udf(_log_tf, VectorUDT())(F.col(self.getInputCol())))


class SmoothIdf(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fits Spark's idf and scales every term by it plus one.  Terms are
    counted where their value is above zero, so it may follow SublinearTf."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ElementwiseProduct:
        idf = IDF(inputCol=self.getInputCol(), outputCol=self.getOutputCol()).fit(dataset).idf
        return ElementwiseProduct(scalingVec=Vectors.dense(idf.toArray() + 1.0), inputCol=self.getInputCol(),
                                  outputCol=self.getOutputCol())
