"""Table, CSV and directory sources and sinks."""
