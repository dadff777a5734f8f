"""Plan-shaping helpers: lineage cuts, hot-key joins, ordered scans, dense ranks."""
