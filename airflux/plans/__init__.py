"""Configured plans: observations, inversion, cache and sweeps."""
