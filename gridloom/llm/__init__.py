"""Operators for preparing training data at corpus scale.

Nothing outside this subpackage imports it; deleting the folder leaves the rest of the library whole.
"""
