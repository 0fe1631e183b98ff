"""Sources and sinks: Parquet, Matrix Market, DataFrames with string keys, optional converters."""
