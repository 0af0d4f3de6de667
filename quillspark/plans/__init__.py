"""Statement front end, query builder and registered plans."""
