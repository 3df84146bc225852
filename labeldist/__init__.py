"""labeldist: Spark-native analytics over texts labelled with probability
distributions on a hierarchical sense taxonomy."""

__version__ = "0.1.0"
