"""Column functions: fingerprints, times, compression tiers, flags, vectors."""
