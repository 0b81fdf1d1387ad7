"""Training-data operators: text cleaning, scoring, deduplication, mixing and token output."""
