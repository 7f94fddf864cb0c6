"""Column expressions: numbers, text, polygons and matrices.  All native, none a UDF."""
