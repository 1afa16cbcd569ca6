"""lakeweave: a Spark-native lake-table engine.

Table formats are read and written as relational programs over commit metadata;
see README.md for the map of subpackages.
"""

__version__ = "0.1.0"
