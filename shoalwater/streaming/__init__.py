"""Part of shoalwater: streaming."""
