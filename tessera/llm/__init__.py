"""Training-data operators: ten text and vector operators and their queries."""
