"""Ranking, work plans, statistics and reports built on the operators."""
