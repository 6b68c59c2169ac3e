"""Knowledge-base corpus, retrieval, feedback and billing jobs for Spark."""
