"""Class probabilities for one-against-the-rest boosting."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class MarginProbabilities(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """``probability`` from the margins of one boosted model per class.

    Each margin F is that model's half log-odds of its class, so its probability is 1 / (1 + exp(-2F)); the classes' are
    divided by their sum.  Margins so low that every probability is zero share it equally.
    """

    rawPredictionCol = Param(Params._dummy(), "rawPredictionCol", "vector of one margin per class", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, rawPredictionCol="rawPrediction"):
        super().__init__()
        self._setDefault(rawPredictionCol="rawPrediction")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        each = F.transform(vector_to_array(self.getOrDefault(self.rawPredictionCol)), lambda m: F.lit(1.0) / (F.lit(1.0) + F.exp(-2.0 * m)))
        out = df.withColumn("_p", each)
        whole = F.aggregate("_p", F.lit(0.0), lambda s, v: s + v)
        share = F.when(whole > 0, F.transform("_p", lambda v: v / whole)).otherwise(F.transform("_p", lambda v: F.lit(1.0) / F.size("_p")))
        return out.withColumn("probability", array_to_vector(share)).drop("_p")
