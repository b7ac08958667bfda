"""Query catalogue and ingest plans."""
