"""Training-data operators. Nothing else in tessera imports this subpackage."""
