"""docengine: parsing, chunking, indexing, searching, answering and evaluating over document collections in Spark."""
