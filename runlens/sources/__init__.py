"""runlens.sources."""
