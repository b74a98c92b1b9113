"""Readers and writers: markup corpora, topics, gazetteers, index tables, run files."""
