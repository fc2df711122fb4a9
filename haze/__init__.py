"""haze: Spark-native cleaning, profiling, model selection and metrics for sensor readings."""

__version__ = "0.1.0"
