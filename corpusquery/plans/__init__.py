"""Configuration, pipelines and the command line."""
