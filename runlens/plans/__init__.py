"""runlens.plans."""
