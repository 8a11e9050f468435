"""Training-data operators: filtering, de-duplication, mixing and token output."""
