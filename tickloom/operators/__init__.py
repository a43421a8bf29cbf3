"""DataFrame operators on canonical events."""
