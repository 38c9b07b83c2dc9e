"""concord.sources package."""
