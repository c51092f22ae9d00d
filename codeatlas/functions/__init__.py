"""Part of codeatlas."""
