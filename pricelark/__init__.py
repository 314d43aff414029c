"""Price intelligence over marketplace catalogues, as Spark DataFrame transformations."""
