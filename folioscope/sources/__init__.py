"""Readers and writers: corpus files, images, questions, chunk tables."""
