"""Sources: driver tables, derived views, delimited files and fetched pages."""
