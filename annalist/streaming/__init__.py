"""Event datasets as streams."""
