"""Training-data operators: ten modules, one operator each, plus their queries."""
