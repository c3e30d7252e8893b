"""Where tuples come from: RDF files, relational tables, dereferenced resources."""
