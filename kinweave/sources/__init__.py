"""Readers and writers: tables, graphs, text lines, generators, metric rows."""
