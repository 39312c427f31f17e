"""Sources and sinks: file scans, parsers, the versioned store."""
