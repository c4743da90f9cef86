"""Training-data operators: ten text operators over documents and pages.

Nothing outside this subpackage imports it.
"""
