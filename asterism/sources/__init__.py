"""Record sources and sinks: JSON lines, JSON dumps of hubs and runtimes, SQLite files, sharded exports, audit logs."""
