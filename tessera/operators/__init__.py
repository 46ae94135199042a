"""DataFrame operators over long repertoire tables: a sample is a value in a row, never a column."""
