"""Training-data operators: de-duplication, filters, scoring, search, packing and mixing."""
