"""The same rules over streams and over batches."""
