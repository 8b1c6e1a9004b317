"""tessella: document-corpus and evaluation analytics expressed as Spark DataFrame plans."""
