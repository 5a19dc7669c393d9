"""Operators for preparing training text: archives, rules, scores, duplicates, mixing and sharding.

Nothing else in the library imports this subpackage.  Each module holds one operator with its own
general interface; :mod:`leafscan.llm.queries` binds them to the tables of the driver.
"""
