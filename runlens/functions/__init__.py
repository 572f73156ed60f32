"""runlens.functions."""
