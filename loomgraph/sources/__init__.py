"""Readers and writers: edge-list text, integer part files, edge tables, result views."""
