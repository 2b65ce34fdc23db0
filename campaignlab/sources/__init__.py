"""Sources and sinks: parquet table sets, derived test views, CSV uploads and
exports, JDBC."""
