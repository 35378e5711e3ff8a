"""Readers: coverage files, diffs, webhooks, domain events and the bound tables."""
