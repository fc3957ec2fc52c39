"""Document-flow analytics on Spark: block repair, chunking, translation checks and reports as DataFrame plans."""
