"""How the given tables stand for the tables of the jobs."""
