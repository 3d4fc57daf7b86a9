"""Readers and writers: CSV tables, CDM records, graph and explanation documents."""
