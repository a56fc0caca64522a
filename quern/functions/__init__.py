"""Column functions over text, vectors and ids."""
