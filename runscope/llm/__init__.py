"""Training-data operators over documents, conversations, embeddings and labels."""
