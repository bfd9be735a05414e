"""Reading and writing: files, messages, tables and replayed streams."""
