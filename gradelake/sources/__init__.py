"""gradelake.sources."""
