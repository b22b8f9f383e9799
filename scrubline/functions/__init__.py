"""Part of scrubline."""
