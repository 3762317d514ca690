"""End-to-end compositions of the operators over the driver tables."""
