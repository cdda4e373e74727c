"""Training-data operators for very large text corpora.

Nothing outside this subpackage imports it; the registry at the repository top adds its queries only
when it is present.
"""
