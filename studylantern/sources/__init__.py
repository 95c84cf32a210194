"""Reading landed feeds and reading / writing tables."""
