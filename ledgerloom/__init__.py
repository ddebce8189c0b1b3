"""ledgerloom: document-field analytics on PySpark DataFrames."""
