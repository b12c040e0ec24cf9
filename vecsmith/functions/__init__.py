"""Column functions: distances, text, media and secrets."""
