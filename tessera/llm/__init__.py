"""Training-data operators: ten jobs over documents, embeddings and pages. Nothing else in the library imports this."""
