"""DataFrame operators over block tables."""
