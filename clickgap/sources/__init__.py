"""Inputs and outputs: export ingest, keyword config, sinks, test-table fixtures."""
