"""Training-data operators on plain document tables.

Nothing outside this subpackage imports it.
"""
