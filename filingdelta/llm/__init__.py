"""Training-data pipeline operators: filtering, deduplication, tokenisation and archive handling."""
