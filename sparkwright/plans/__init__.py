"""Composite plans: preparation flows and the registered query catalog."""
