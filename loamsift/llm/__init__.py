"""Training-data operators: ten corpus-scale components that stand apart from the rest of the library."""
