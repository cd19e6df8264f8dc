"""Plan building, validation, repair, clustering and ordering."""
