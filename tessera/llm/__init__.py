"""Training-data operators: filters, detectors, near-duplicate search and mixing over text tables.

Nothing outside this subpackage imports it.
"""
