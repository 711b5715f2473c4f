"""Training-data operators: each module holds one, queries.py registers them."""
