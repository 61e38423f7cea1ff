"""Spark-native analytics over large mutation tables.

Every operator is a plain function from DataFrame to DataFrame.  Nothing in
``operators`` reads or writes storage; that is left to ``sources`` and
``streaming``.
"""

from varloom.roles import Roles

__all__ = ["Roles"]
