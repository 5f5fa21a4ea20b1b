"""Training-data operators: deduplication, tokenisation, packing, sharding, search and text classifiers."""
