"""Training-data operators over documents and embeddings. Nothing else in the library imports this subpackage."""
