"""Part of the library engine."""
