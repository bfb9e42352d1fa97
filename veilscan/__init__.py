"""veilscan: hidden-content screening of large corpora on Spark."""
