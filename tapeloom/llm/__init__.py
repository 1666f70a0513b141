"""Training-data operators over the documents, benchmark, labels and embeddings tables."""
