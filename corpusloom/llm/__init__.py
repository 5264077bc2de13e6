"""Training-data operators: near duplicates, search, classifiers, decontamination, mixing, token files."""
