"""concord.streaming package."""
