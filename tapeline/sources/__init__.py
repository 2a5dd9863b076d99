"""Readers and writers: tables, landed payloads and text records."""
