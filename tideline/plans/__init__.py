"""Configuration, load methods and runs."""
