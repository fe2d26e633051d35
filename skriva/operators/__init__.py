"""Tokenizers, token filters, index building, dictionary, boolean queries and ranking, as DataFrame and Column operations."""
