"""Training-data operators: decontamination, archives, dedup, tokenisation, formatting."""
