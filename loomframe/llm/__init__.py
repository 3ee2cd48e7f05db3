"""Training-data operators: one module per operator, each with its own general interface and one thin query."""
