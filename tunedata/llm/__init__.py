"""Training-data pipeline operators over the text tables (documents, pages).

Each module holds one operator with a general interface; ``queries`` registers
one thin query per operator over the driver tables.  Nothing else in the
library imports this package.
"""
