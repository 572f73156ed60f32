"""runlens.operators."""
