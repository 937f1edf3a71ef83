"""corpusloom: document-corpus analytics on PySpark DataFrames."""
