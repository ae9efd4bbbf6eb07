"""Part of glossaria."""
