"""Stream-static enrichment."""
