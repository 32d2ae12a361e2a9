"""Training-data operators: one module each, none imported by the rest of the library."""
