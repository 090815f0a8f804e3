"""tidemark: operational analytics over company records, as PySpark DataFrame transformations."""
