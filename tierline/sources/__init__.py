"""Raw sources (declared schemas, readers, the test-data adapter) and sinks."""
