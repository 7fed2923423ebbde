"""Reading and writing evidence tables."""
