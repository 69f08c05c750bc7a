"""Readers and writers: tables, lakes, ground truths, stages and run results."""
