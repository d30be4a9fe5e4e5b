"""Column functions and fingerprints."""
