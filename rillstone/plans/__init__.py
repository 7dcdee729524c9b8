"""Session settings and lineage cuts."""
