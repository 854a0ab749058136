"""Search of documents that mix prose with TeX formulae, on PySpark."""
