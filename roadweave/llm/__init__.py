"""Training-data operators: search, deduplication, filtering, scanning, extraction and packing.

Nothing outside this subpackage imports it. Every operator is a DataFrame -> DataFrame
function with its own column-name parameters; ``queries`` binds them to the tables.
"""
