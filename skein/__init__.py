"""skein: a Spark-native code-and-knowledge graph engine.

The tables ``symbols`` and ``edges`` describe source trees as a typed property
graph; every operator is a DataFrame plan over them.
"""

__version__ = "0.1.0"
