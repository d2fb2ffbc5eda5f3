"""Part of shoalwater: functions."""
