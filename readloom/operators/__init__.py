"""Relational operators over reads: every statistic and encoding decision."""
