"""Readers and writers: registry files, labels, predictions, text boxes, summaries."""
