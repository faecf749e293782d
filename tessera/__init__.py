"""tessera: text corpora as Spark tables.

Documents, stand-off annotations (character spans with attributes), links
between spans and an inverted index, with every operator written as a
DataFrame -> DataFrame function over Spark SQL expressions, joins, windows
and aggregates.
"""

__version__ = "0.1.0"
