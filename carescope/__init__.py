"""carescope: Spark-native risk-scoring analytics.

Every operator is a DataFrame -> DataFrame function built from native Column
expressions; see README.md for the module map.
"""

__version__ = "0.1.0"
