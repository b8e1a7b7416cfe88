"""Configuration, and pipelines as graphs of DataFrames."""
