"""Sources: driver tables, adapters to the platform's table shapes, JSONL IO."""
