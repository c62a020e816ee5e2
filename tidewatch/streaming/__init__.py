"""The same detection on a stream of new files."""
