"""The engine's operations as named queries over the table folders, and the same in SQL."""
