"""quillgraph: outline-graph retrieval on Spark."""
