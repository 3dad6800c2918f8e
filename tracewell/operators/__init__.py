"""Operators over messages, events, registries and pages."""
