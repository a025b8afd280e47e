"""quillgraph: a PySpark-native engine for chunked document and source-code corpora.

Every operator is a function from DataFrames to DataFrames.  The sub-packages:

* ``functions``  column expressions and scalar text / vector functions
* ``operators``  relational, retrieval, graph and state operators
* ``sources``    readers, writers, published snapshots
* ``plans``      the registered queries and their SQL
* ``streaming``  Structured Streaming forms of the log and lease operators
"""

__version__ = "0.1.0"
