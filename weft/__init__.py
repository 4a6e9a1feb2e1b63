"""weft: ontology matching, record linkage and word vectors as Spark plans."""
