"""Training-data operators: mixing, packing, filtering, identification, output, deduplication, sharding."""
