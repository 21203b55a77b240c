"""Readers and writers: files by format, JDBC, Arrow origins, and bulk copies that convert by declared type."""
