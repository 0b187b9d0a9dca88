"""Operators that prepare text corpora for model training.

Nothing outside this subpackage imports it. Every operator reads only the columns it
names, so tables may carry further columns of any name; the results hold only what the
docstring of the operator lists.
"""
