"""shoalwater: fraud-signal analytics over message tables, as Spark plans."""
