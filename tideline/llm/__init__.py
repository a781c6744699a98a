"""Training-data operators: ten stand-alone components over tables of documents.

Nothing outside this package imports it; it can be deleted without breaking the rest.
"""
