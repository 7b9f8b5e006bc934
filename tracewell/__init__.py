"""tracewell: a PySpark engine for forensic analysis of captured web content and of the corpora made from it."""
