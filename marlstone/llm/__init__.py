"""Operators for building training data: defective answers, quotas, near duplicates, matching, leakage, mixing, quality."""
