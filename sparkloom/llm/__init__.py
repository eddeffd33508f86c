"""Training-data operators: token counts, near duplicates, classifiers, extraction and mixing."""
