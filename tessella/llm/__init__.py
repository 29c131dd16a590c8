"""Training-data operators: language ID, line and near-duplicate removal, mixing, packing, scoring.

Each module holds one operator as DataFrame functions; ``queries`` wires them to the entry file.
Nothing else in the library imports this subpackage.
"""
