"""Jobs made of operators, and the query registry."""
