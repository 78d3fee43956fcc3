"""Readers and writers for the text formats of the measuring programs."""
