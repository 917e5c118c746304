"""Physical plan patterns used by several operators."""
