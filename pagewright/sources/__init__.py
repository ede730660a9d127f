"""Tables and settings."""
