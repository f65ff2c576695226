"""Points in and out."""
