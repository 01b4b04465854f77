"""Training-data preparation operators.

One module per operator; ``registry`` holds the registered queries and their SQL. Nothing else in
the library imports this subpackage.
"""
