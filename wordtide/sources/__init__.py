"""Readers of subtitles, word lists, frequencies, levels, tier tables and state files; all by Spark's own sources."""
