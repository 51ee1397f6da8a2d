"""Table readers and writers, page extraction."""
