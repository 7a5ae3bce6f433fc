"""Operators over the transaction table: quality, KPIs / segments, thresholds, monitoring."""
