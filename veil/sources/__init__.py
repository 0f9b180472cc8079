"""Reading and writing datasets, and generated sample tables."""
