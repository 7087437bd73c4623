"""gradelake.functions."""
