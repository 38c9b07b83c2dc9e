"""concord.plans package."""
