"""Readers, integrity gates, keyed lookups and write-once sinks."""
