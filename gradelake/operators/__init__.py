"""gradelake.operators."""
