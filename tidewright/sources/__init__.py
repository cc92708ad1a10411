"""Sources and sinks: format detection, lazy readers, Python data sources, writers."""
