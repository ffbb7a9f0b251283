"""Change feeds: last-writer-wins merges of micro-batches."""
