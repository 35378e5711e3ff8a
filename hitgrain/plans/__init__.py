"""Reports composed of several operators."""
