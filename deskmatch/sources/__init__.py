"""Reading tables and files, and keyed writes."""
