"""Composed queries: rulesets, scoring, reports."""
