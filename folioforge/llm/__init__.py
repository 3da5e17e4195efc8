"""Training-data pipeline operators: ten self-contained stages over text corpora.

Nothing outside this subpackage imports it.
"""
