"""Readers: every reader returns good events and typed errors with their place in the source."""
