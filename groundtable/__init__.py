"""groundtable: documentation-retrieval and corpus building as ordinary Spark jobs."""
