"""Training-data operators over text corpora and embeddings; nothing outside this folder imports it."""
