"""kinweave: k-nearest-neighbour graphs and pair-wise data processing as Spark DataFrames.

A graph is two frames, ``nodes(id, value, partition)`` and ``edges(src, dst, sim[, rank])``.
One tie rule holds everywhere: ``sim`` descending, then ``dst`` ascending.
"""

__version__ = "0.1.0"
