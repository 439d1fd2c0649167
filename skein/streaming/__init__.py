"""Part of skein: streaming."""
