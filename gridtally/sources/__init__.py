"""Sources and sinks: CSV files, stored tables, JDBC databases."""
