"""Readers and writers: array archives, cell-dictionary CSV tables, matching tables, result layout."""
