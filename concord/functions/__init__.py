"""concord.functions package."""
