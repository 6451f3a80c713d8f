"""Operators that prepare text and trajectories for language-model training.

Nothing outside this subpackage imports it; ``queries.py`` lists its queries.
"""
