"""The same rules on streams."""
