"""Column functions: projection, shapes, hexagonal cells, calendar and text."""
