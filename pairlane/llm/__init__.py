"""Training-data operators over the documents, embeddings and conversations tables."""
