"""Operators over DataFrames: mutations, folding, compaction, ranking, lookups."""
