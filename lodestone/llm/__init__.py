"""Operators for preparing training text at scale.

Nothing outside this package imports it. ``queries.py`` holds the registered
queries and their SQL; each other module is one operator or a shared part.
"""
