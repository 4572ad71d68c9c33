"""Readers for delimited text and workbooks, header detection, type inference,
the sensitive-data scan and the report writer."""
