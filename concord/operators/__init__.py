"""concord.operators package."""
