"""The driver tables as a filing corpus, and the queries over it."""
