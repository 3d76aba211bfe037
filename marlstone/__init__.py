"""marlstone: PySpark-native operators for corpora of segmented filings and the metrics beside them."""
