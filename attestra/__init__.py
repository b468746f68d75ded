"""attestra: claim verification against evidence as DataFrame transformations on Spark."""
