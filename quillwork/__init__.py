"""quillwork: analytical operators for monitoring workloads, expressed as Spark plans."""
