"""gradelake.streaming."""
