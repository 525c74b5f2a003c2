"""Which topics are edited from which regions of the world, as Spark jobs.

Every operator is a function from DataFrame to DataFrame; nothing here creates
a session.  See README.md for the map from question to function.
"""
