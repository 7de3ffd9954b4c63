"""Column functions: no shuffle, no state, usable in batch, in SQL and in streams alike."""
