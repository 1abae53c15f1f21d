"""Evidence analytics over digitised pages, expressed as Spark DataFrame plans."""
