"""Training-data operators: one module per operator, and ``registry`` for the queries that apply them."""
