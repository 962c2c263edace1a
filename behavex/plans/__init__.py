"""Jobs, and the catalogue of queries with the SQL that checks them."""
