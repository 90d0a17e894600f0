"""corpusmill: corpus analytics on Spark, as DataFrame-to-DataFrame functions."""
