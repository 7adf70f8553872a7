"""Daily landing files to SCD2 history on Spark: ingest, compress, combine, track, check."""
