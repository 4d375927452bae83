"""Operators for turning the text that the engine keeps about events (reasons, payloads, reports) into training data.

Nothing else in the library imports this subpackage.
"""
