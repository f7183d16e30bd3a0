"""Part of the tessella engine."""
