"""Sources and sinks: document files, schema discovery, versioned tables, control files."""
