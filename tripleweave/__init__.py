"""Graph pattern queries over subject-predicate-object triples, as plain PySpark."""
