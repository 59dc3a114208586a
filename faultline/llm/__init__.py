"""Training-data operators: thirteen corpus-scale stages, each usable on its own.

Nothing else in the library imports this subpackage.
"""
