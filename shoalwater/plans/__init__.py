"""Part of shoalwater: plans."""
