"""Operators for preparing training corpora at scale.

Nothing outside this subpackage imports it; ``__spark_entry__`` registers its queries when it is present.
"""
