"""runlens.streaming."""
