"""Plan-level helpers: sessions, lineage cuts, skew-safe ordered scans, joins."""
