"""XML at scale on Spark: documents are rows, XML operators are DataFrame operators."""
