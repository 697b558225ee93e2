"""Column -> Column building blocks. Nothing here runs a job or moves a row."""
