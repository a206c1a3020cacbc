"""Readers and writers: place tables, shard catalogs, JSON and GeoJSON."""
