"""Part of shoalwater: operators."""
