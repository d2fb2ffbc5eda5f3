"""Part of shoalwater: sources."""
