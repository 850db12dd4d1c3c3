"""Streaming twins: row rules, incremental reports, merged insight history, keyed stream state."""
