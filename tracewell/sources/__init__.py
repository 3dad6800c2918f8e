"""Readers with contracts, and the message corpus."""
