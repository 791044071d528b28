"""weft: entity resolution and record linkage as Spark DataFrame dataflows."""
