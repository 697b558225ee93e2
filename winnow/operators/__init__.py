"""DataFrame -> DataFrame operators on explicit keys."""
