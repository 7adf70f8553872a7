"""Jobs made of the operators: daily flow, SQL models, and the catalogue of queries."""
