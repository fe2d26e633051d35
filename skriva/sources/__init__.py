"""Loaders of documents and stores of the engine's tables."""
