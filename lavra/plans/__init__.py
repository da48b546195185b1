"""Plans of the document-analytics engine."""
