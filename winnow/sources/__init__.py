"""Readers and writers: files, archives, sheets and the candidate store."""
