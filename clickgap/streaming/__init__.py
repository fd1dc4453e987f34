"""Stateless enrichment on streaming sources."""
