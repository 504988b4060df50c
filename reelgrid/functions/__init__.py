"""Column functions: phonetic keys, title and name text, similarity, rendering."""
