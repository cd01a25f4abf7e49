"""Readers and writers of file formats. Files are listed and read by Spark, so any store that Spark knows will do."""
