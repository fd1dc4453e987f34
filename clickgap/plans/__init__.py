"""End-to-end run, the registered query catalog and its DuckDB oracles."""
