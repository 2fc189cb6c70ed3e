"""Readers and writers: raw recordings, arrays, candidate lists, reports."""
