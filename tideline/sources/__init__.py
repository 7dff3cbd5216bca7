"""Readers and writers over a landing zone."""
