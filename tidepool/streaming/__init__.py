"""The per-read operators over streams."""
