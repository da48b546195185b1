"""Sources: HTML pages, office files and text corpora."""
