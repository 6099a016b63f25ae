"""Training-data operators.

Nothing else in the package imports this subpackage; the folder can be removed
and the rest of the library keeps working.
"""
