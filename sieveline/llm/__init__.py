"""Training-data operators: classifiers, rules, near-duplicates, tokens and packing."""
