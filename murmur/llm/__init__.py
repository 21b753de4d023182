"""Training-data operators: ten corpus jobs and their registered queries.

Nothing else in the library imports this subpackage."""
